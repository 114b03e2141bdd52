"""BM25 and dense retrieval, rewriting and evaluation."""

import math

import numpy as np
import pytest

from tarn.operators import bm25, dense, evaluation, rewrite

CHUNKS = "chunk_id long, embedding array<float>, embedding_model string, embedding_dimensions int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], m, 2) for i, v, m in rows], CHUNKS)


def asked(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "query_id long, embedding array<float>")


def test_exact_topk(spark):
    chunks = vectors(spark, [(1, (1, 0), "m"), (2, (0, 1), "m"), (3, (-1, 0), "m"), (4, (1, 0), "other"), (5, (0, 0), "m"), (6, (2, 0), "m")])
    got = dense.exact_topk(asked(spark, (1, 0)), chunks, 10, 2, "m").orderBy("rank").collect()
    assert [(r["chunk_id"], r["cosine_similarity"]) for r in got] == [(1, 1.0), (6, 1.0), (2, 0.0), (3, -1.0), (5, None)]


@pytest.mark.parametrize("vector", [(0, 0), (1,), (float("nan"), 1), (float("inf"), 1)])
def test_bad_query_vectors(spark, vector):
    with pytest.raises(ValueError):
        dense.exact_topk(asked(spark, vector), vectors(spark, [(1, (1, 0), "m")]), 1, 2).collect()


def test_no_queries_and_no_chunks(spark):
    assert dense.exact_topk(asked(spark, (1, 0)).limit(0), vectors(spark, [(1, (1, 0), "m")]), 3, 2).count() == 0
    assert dense.exact_topk(asked(spark, (1, 0)), vectors(spark, []), 3, 2).count() == 0


def test_lists_probe_all_equals_exact(spark):
    rng = np.random.default_rng(3)
    chunks = vectors(spark, [(i, v, "m") for i, v in enumerate(rng.normal(size=(300, 2)))])
    queries = asked(spark, *rng.normal(size=(4, 2)))
    index = dense.build_lists(chunks, 2, lists=8)
    exact = dense.exact_topk(queries, chunks, 5, 2)
    key = ["query_id", "rank"]
    assert dense.ann_topk(queries, index, 5, 2, nprobe=8).orderBy(key).collect() == exact.orderBy(key).collect()
    assert dense.recall(dense.ann_topk(queries, index, 5, 2, nprobe=3), exact).first()["recall"] >= 0.9
    assert index.chunks.count() == 300


def test_plan_text_shows_the_scan(spark):
    assert "MapInArrow" in dense.plan_text(dense.exact_topk(asked(spark, (1, 0)), vectors(spark, [(1, (1, 0), "m")]), 1, 2))


TEXTS = [(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, "delta"), (5, "beta gamma")]


def scored(query, k1=1.5, b=0.75):
    docs = {i: t.split() for i, t in TEXTS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in query.split():
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(term):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * len(d) / mean))
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


@pytest.mark.parametrize("query", ["beta", "beta beta alpha", "gamma delta", "nothing"])
def test_bm25_scores(spark, query):
    chunks = spark.createDataFrame(TEXTS, "chunk_id long, retrieval_text string")
    got = bm25.bm25_topk(spark.createDataFrame([(0, query)], "query_id long, query string"), bm25.build_index(chunks), 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [i for i, _ in scored(query)]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in scored(query)], abs=1e-8)


def test_a_segmenter_in_place_of_pairs(spark, tmp_path):
    def words_of(run):
        """A dictionary of three words, in search mode: all that a run holds."""
        return [w for w in ("请求", "请求体", "对象") if w in run]

    chunks = spark.createDataFrame([(1, "接口接收 JSON 对象"), (2, "请求体 request_body"), (3, "OAuth2PasswordBearer 422")], "chunk_id long, retrieval_text string")
    queries = spark.createDataFrame([(0, "请求体"), (1, "对象 json"), (2, "422"), (3, "没有")], "query_id long, query string")
    for segmenter in (None, words_of):
        index = bm25.build_index(chunks, segmenter=segmenter)
        got = {r["query_id"]: r["chunk_id"] for r in bm25.bm25_topk(queries, index, 1, segmenter=segmenter).collect()}
        assert got == {0: 2, 1: 1, 2: 3}
    assert {r["term"] for r in index.term_stats.collect()} == {"对象", "json", "请求", "请求体", "request_body", "oauth2passwordbearer", "422"}
    bm25.publish(chunks, str(tmp_path), "m", 2, segmenter=words_of)
    with pytest.raises(bm25.IndexMismatch):
        bm25.load(spark, str(tmp_path), "m", 2)
    assert bm25.load(spark, str(tmp_path), "m", 2, words_of).corpus_stats.first()["n"] == 3


def test_bm25_generations(spark, tmp_path):
    root = str(tmp_path / "bm25")
    chunks = spark.createDataFrame(TEXTS, "chunk_id long, retrieval_text string")
    with pytest.raises(bm25.IndexMissing):
        bm25.load(spark, root, "m", 2)
    first = bm25.publish(chunks, root, "m", 2)
    with pytest.raises(bm25.EmptyCorpus):
        bm25.publish(chunks.limit(0), root, "m", 2)
    assert bm25.load(spark, root, "m", 2).corpus_stats.first()["n"] == 5
    with pytest.raises(bm25.IndexMismatch):
        bm25.load(spark, root, "m", 3)
    assert bm25.publish(chunks.limit(2), root, "m", 2) != first
    assert bm25.load(spark, root, "m", 2).corpus_stats.first()["n"] == 2


def rewritten(spark, query, **more):
    return rewrite.rewrite_queries(spark.createDataFrame([(query,)], "query string"), **more).first()


def test_rewrite(spark):
    got = rewritten(spark, "  ＰＧ  的 WAL 和依赖注入  ")
    assert got["normalized_query"] == "PG 的 WAL 和依赖注入"
    assert got["effective_query"] == "PostgreSQL (PG) 的 Write-Ahead Log (WAL) 和Dependency Injection (依赖注入)"
    assert got["applied_rules"] == ["unicode_nfkc", "whitespace", "alias:PG", "alias:WAL", "alias:依赖注入"]
    again = rewritten(spark, got["effective_query"])
    assert again["effective_query"] == got["effective_query"] and again["applied_rules"] == []


def test_rewrite_bounds_and_switch(spark):
    assert rewritten(spark, "FastAPI api")["effective_query"] == "FastAPI Application Programming Interface (api)"
    assert rewritten(spark, " PG ", enabled=False)["effective_query"] == " PG "
    with pytest.raises(Exception, match="blank query"):
        rewritten(spark, "   ")


@pytest.mark.parametrize("text", ["[]", "no", '{"version": 2, "aliases": {"a": "b"}}', '{"version": true, "aliases": {"a": "b"}}', '{"version": 1, "aliases": {}}', '{"version": 1, "aliases": {"a": " "}}', '{"version": 1, "aliases": {"PG": "x", "pg": "y"}}'])
def test_bad_aliases(text):
    with pytest.raises(rewrite.BadAliases):
        rewrite.load_aliases(text)


def test_quality_and_latency(spark):
    queries = spark.createDataFrame([(0,), (1,)], "query_id long")
    hits = spark.createDataFrame([("m", 0, 1, True), ("m", 1, 5, False), ("m", 1, 6, True), ("m", 1, 8, True)], "method string, query_id long, rank int, is_relevant boolean")
    row = evaluation.quality(evaluation.first_relevant_rank(queries, hits, ["method"]), ["method"]).first()
    assert (row["recall_5"], row["recall_10"], row["mrr_10"]) == (0.5, 1.0, pytest.approx((1 + 1 / 6) / 2))
    took = evaluation.latency(spark.createDataFrame([("m", 10.0), ("m", 30.0)], "method string, latency_ms double"), ["method"]).first()
    assert (took["mean_ms"], took["p95_ms"]) == (20.0, 29.0)


def test_latency_of_many_equal_and_null_values(spark):
    rng = np.random.default_rng(1)
    values = {"a": [float(x) for x in rng.integers(0, 30, 700)], "b": [5.0] * 90, "c": [2.5]}
    rows = [(name, v) for name, held in values.items() for v in held] + [("a", None)]
    frame = spark.createDataFrame(rows, "method string, latency_ms double").repartition(5)
    got = {r["method"]: (r["mean_ms"], r["p95_ms"]) for r in evaluation.latency(frame, ["method"]).collect()}
    assert got == {name: (pytest.approx(np.mean(held)), pytest.approx(np.percentile(held, 95))) for name, held in values.items()}
    assert evaluation.latency(frame.limit(0), ["method"]).count() == 0


def test_queries_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    chunks = vectors(spark, [(i, v, "m") for i, v in enumerate(rng.normal(size=(60, 2)))])
    queries = asked(spark, *rng.normal(size=(7, 2)))
    one = dense.exact_topk(queries, chunks, 5, 2).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 4)
    assert dense.exact_topk(queries, chunks, 5, 2).orderBy("query_id", "rank").collect() == one


def test_a_task_holds_bounded_products(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    batches = []
    for i in range(2):  # equal vectors, and some without length
        rows = np.repeat(rng.normal(size=(2_000, 4)), 2, axis=0).astype(np.float32)
        rows[:5] = 0
        batches.append(pa.RecordBatch.from_arrays([pa.array(4_000 * i + rng.permutation(4_000)), pa.array(list(rows), pa.list_(pa.float32()))], ["chunk_id", "embedding"]))
    asked = rng.normal(size=(4_000, 4))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    tracemalloc.start()
    got = next(dense._best((list(range(4_000)), asked), 3, None)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # a whole batch of products has 128 MB
    every, chunk = np.concatenate([dense._matrix(b.column(1), 4) for b in batches]), np.concatenate([b.column(0).to_numpy() for b in batches])
    length = np.linalg.norm(every, axis=1)
    for q in range(0, 4_000, 500):
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(length > 0, np.round(1 - every @ asked[q] / length, dense.DIGITS), np.inf)
        want = np.lexsort((chunk, distance))[:3]
        assert got.column(1).to_numpy()[3 * q : 3 * q + 3].tolist() == chunk[want].tolist()
    monkeypatch.setattr(dense, "TILE", 1)
    few = dense._best((list(range(20)), asked[:20]), 4_005, None)
    got = next(few(iter(batches)))
    assert len(got) == 20 * 4_005
