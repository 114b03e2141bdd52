"""Approximate search: codes against plain loops, recall and bytes against exact search, edges."""

import numpy as np
import pytest

from tarn.operators import dense, quantized


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<float>").repartition(3)


def asked(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    return (centers[rng.integers(0, 12, 1_500)] + 0.5 * rng.normal(size=(1_500, 16))).astype(np.float32)


def test_codes_are_the_nearest_ones():
    rng = np.random.default_rng(2)
    vectors, centers = rng.normal(size=(40, 5)), rng.normal(size=(3, 5))
    books = quantized.fit_books(vectors - centers[np.argmax(vectors @ centers.T, axis=1)], 1)
    own, codes = quantized.encoded(vectors, centers, books)
    for v, o, c in zip(vectors, own, codes):
        assert o == max(range(3), key=lambda i: v @ centers[i])
        rest = np.r_[v - centers[o], 0.0]
        for m, code in enumerate(c):
            far = ((books[m] - rest[2 * m : 2 * m + 2]) ** 2).sum(1)
            assert far[code] == pytest.approx(far.min())
    assert codes.shape == (40, 3)


def test_recall_and_bytes(spark, clustered, tmp_path):
    chunks, queries = table(spark, clustered), asked(spark, clustered[::100])
    index = quantized.build(chunks, 16, path=str(tmp_path / "i"))
    exact = {(r["query_id"], r["rank"], r["chunk_id"], r["cosine_distance"]) for r in dense.exact_topk(queries, chunks, 10, 16).collect()}
    found = quantized.search(queries, index, 10, 16)
    got = {(r["query_id"], r["rank"], r["chunk_id"], r["cosine_distance"]) for r in found.rows.collect()}
    near = {(q, c) for q, _, c, _ in got}
    assert len(near & {(q, c) for q, _, c, _ in exact}) >= 0.9 * len(exact) and len(got) == len(exact)
    of = {(q, c): d for q, _, c, d in exact}
    assert all(d == pytest.approx(of[q, c], abs=1e-11) for q, _, c, d in got if (q, c) in of)
    read = quantized.bytes_share(found, index, 1_500).first()
    assert read["queries"] == 15 and read["vectors"] == 15 * 30 and read["share"] < 0.25
    fewer = quantized.search(queries, index, 10, 16, nprobe=3)
    assert quantized.bytes_share(fewer, index, 1_500).first()["codes"] < read["codes"] / 2
    again = quantized.load(spark, str(tmp_path / "i"))
    assert np.array_equal(again.books, index.books) and again.chunks.count() == 1_500


def test_every_list_and_a_long_short_list_is_exact(spark, clustered, monkeypatch):
    chunks, queries = table(spark, clustered[:200]), asked(spark, clustered[:200:50])
    index = quantized.build(chunks, 16, lists=4)
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 32)  # two queries a block
    rows = [sorted(map(tuple, f.select("query_id", "rank", "chunk_id").collect())) for f in (quantized.ann_topk(queries, index, 7, 16, 4, 200), dense.exact_topk(queries, chunks, 7, 16))]
    assert rows[0] == rows[1]


def test_ties_bad_vectors_and_empty_tables(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 0.0]), (10, None), (11, [float("nan"), 1.0]), (12, [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = asked(spark, np.array([[1.0, 0.0]]))
    got = quantized.ann_topk(queries, quantized.build(chunks, 2), 3, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["cosine_distance"]) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert quantized.ann_topk(queries, quantized.build(chunks.limit(0), 2), 3, 2).count() == 0
    assert quantized.ann_topk(queries.limit(0), quantized.build(chunks, 2), 3, 2).count() == 0
    with pytest.raises(ValueError):
        quantized.search(queries, quantized.build(chunks, 2), 0, 2)


def test_a_task_holds_bounded_products():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, asked = 4_000, rng.normal(size=(4_000, 4))
    centers, books = rng.normal(size=(5, 4)), rng.normal(size=(2, quantized.CODES, 2))
    lists, codes, probes = rng.integers(0, 5, n).astype(np.int32), rng.integers(0, 256, (n, 2)).astype(np.uint8), rng.random((4_000, 5)) < 0.6
    batch = pa.RecordBatch.from_arrays([pa.array(rng.permutation(n)), pa.array([c.tobytes() for c in codes]), pa.array(lists)], ["chunk_id", "code", "list"])
    tracemalloc.start()
    got = next(quantized._candidates(list(range(4_000)), asked, (centers, books), probes, 6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # a whole batch of products has 128 MB
    found, q = got.to_pandas(), next(i for i in range(4_000) if probes[i].any())
    product = asked[q] @ centers[lists].T + sum(book[code] @ asked[q, 2 * m : 2 * m + 2] for m, (book, code) in enumerate(zip(books, codes.T)))
    product[~probes[q][lists]] = -np.inf
    want = np.argsort(-product)[:6]
    own = found[found.query_id == q].sort_values("product", ascending=False)
    assert own.chunk_id.tolist() == batch.column(0).to_numpy()[want].tolist() and own["product"].tolist() == pytest.approx(product[want].tolist())
    assert found.codes.sum() == probes[:, lists].sum()
