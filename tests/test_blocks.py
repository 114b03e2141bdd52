"""Pruned BM25 against scoring everything."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.operators import blocks, bm25


def corpus(n=600, seed=2):
    """Zipf-like words; some chunks equal, some without terms, one long."""
    rng = random.Random(seed)
    rows = [(i * 7, " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randint(3, 60)))) for i in range(n)]
    return rows + [(5_000 + i, rows[3][1]) for i in range(20)] + [(9_000, ""), (9_001, None), (9_002, "w1 " * 3_000 + "rare")]


QUERIES = [(0, "w1 w2 w3 rare"), (1, "w17 w17 w4 w250"), (2, "nothing known"), (3, "w1"), (4, None), (5, " ".join(f"w{i}" for i in range(120)))]


def tables(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, retrieval_text string").repartition(3), spark.createDataFrame(QUERIES, "query_id long, query string")


def rows_of(frame):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("block, k", [(128, 10), (4, 3), (4, 1), (16, 1000)])
def test_same_rows_as_scoring_everything(spark, block, k):
    chunks, queries = tables(spark, corpus())
    full = rows_of(bm25.bm25_topk(queries, bm25.build_index(chunks), k))
    found = blocks.search(queries, blocks.build(chunks, block=block), k)
    got = rows_of(blocks.ranked(found, k))
    assert [r[:3] for r in got] == [r[:3] for r in full] and [r[3] for r in got] == pytest.approx([r[3] for r in full], abs=2e-9)
    done = {r["query_id"]: r for r in blocks.work_done(found).collect()}
    assert set(done) == {0, 1, 3, 5} and all(0 <= r["scored"] <= r["postings"] for r in done.values())
    if k == 1:
        assert done[0]["skipped"] > 0.2  # in shards of some 80 chunks


def test_common_terms_beside_a_rare_one_are_hardly_read():
    rng = np.random.default_rng(1)
    n, norm = 20_000, lambda dl: 1.5 * (0.25 + 0.75 * dl / 50)
    dl = rng.integers(20, 90, n)

    def posting(ids):
        tf = rng.integers(1, 4, len(ids)).astype(np.int32)
        cuts = np.arange(0, len(ids), 128)
        return blocks._Postings(ids, tf, dl[ids], np.maximum.reduceat(tf, cuts), np.minimum.reduceat(dl[ids], cuts), norm)

    postings = {"rare": posting(np.arange(7, n, 900)), "often": posting(np.arange(0, n, 2)), "always": posting(np.arange(n))}
    asked = [("always", 0.1), ("rare", 7.0), ("often", 0.7), ("unknown", 3.0)]
    everything = np.zeros(n)
    for term, weight in asked[:3]:
        everything[postings[term].ids] += weight * postings[term].parts(slice(None))
    want = np.lexsort((np.arange(n), -np.round(everything, 9)))[:5]
    ids, scores, total, scored = blocks.best_of(asked, postings, 5, 128)
    assert ids.tolist() == want.tolist() and scores == pytest.approx(everything[want]) and scored < 0.01 * total


def test_queries_in_blocks_and_a_published_index(spark, monkeypatch, tmp_path, capsys):
    chunks, queries = tables(spark, corpus(200))
    full = rows_of(bm25.bm25_topk(queries, bm25.build_index(chunks), 5))
    path = str(tmp_path / "index")
    buckets = blocks.save(chunks, path)
    monkeypatch.setattr(blocks, "ASKED_ROWS", 50)
    index = blocks.load(spark, path, buckets)
    assert [r[:3] for r in rows_of(blocks.bm25_topk(queries, index, 5))] == [r[:3] for r in full]
    spark.sql(f"DROP TABLE {blocks._name(path)}")  # another session knows the files only
    index = blocks.load(spark, path, buckets)
    assert [r[:3] for r in rows_of(blocks.bm25_topk(queries, index, 5))] == [r[:3] for r in full]
    grouped = index.rows.filter(F.col("term").isin("w1", "w2")).groupBy("shard").applyInArrow(lambda key, t: t, blocks.ROWS)
    grouped.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "w1" in plan[plan.index("PushedFilters") :]


def test_edges(spark):
    chunks, queries = tables(spark, [(1, None), (2, "")])
    assert blocks.bm25_topk(queries, blocks.build(chunks), 5).count() == 0
    chunks, queries = tables(spark, corpus(20))
    assert blocks.bm25_topk(queries.limit(0), blocks.build(chunks), 5).count() == 0
    with pytest.raises(ValueError):
        blocks.search(queries, blocks.build(chunks), 0)


def test_a_long_query_costs_little_more_than_its_postings():
    """Many terms in many chunks: every posting is touched about once, not every chunk at hand for each term."""
    import time

    rng = np.random.default_rng(3)
    n, norm = 16_000, lambda dl: 1.5 * (0.25 + 0.75 * dl / 50)
    dl, postings = rng.integers(20, 90, n), {}
    for i in range(400):
        ids = np.flatnonzero(rng.random(n) < (0.3 if i < 40 else 0.01)) * 3
        tf = rng.integers(1, 4, len(ids)).astype(np.int32)
        cuts = np.arange(0, len(ids), 128)
        postings[f"w{i}"] = blocks._Postings(ids, tf, dl[ids // 3], np.maximum.reduceat(tf, cuts), np.minimum.reduceat(dl[ids // 3], cuts), norm)
    asked = [(f"w{i}", 1.0 if i < 40 else 4.0) for i in range(400)]
    everything = np.zeros(n)
    for term, weight in asked:
        everything[postings[term].ids // 3] += weight * postings[term].parts(slice(None))
    want = np.lexsort((np.arange(n), -np.round(everything, 9)))[:30]
    start = time.perf_counter()
    for term, weight in asked:  # what a pass over all postings takes here
        everything[postings[term].ids // 3] += weight * postings[term].parts(slice(None))
    plain, shard = time.perf_counter() - start, blocks._Shard(postings)
    start = time.perf_counter()
    for _ in range(3):
        ids, _, total, scored = blocks.best_of(asked, shard, 30, 128)
    took = (time.perf_counter() - start) / 3
    assert ids.tolist() == (3 * want).tolist() and scored <= total and took < 3 * plain


@pytest.mark.parametrize("numbers", [0, 40, 1 << 23])
def test_queries_scored_whole_give_the_rows_of_pruned_ones(monkeypatch, numbers):
    """With common terms in a matrix or not, in blocks, and without chunks that are gone."""
    rng = random.Random(8)
    counts = [[{"term": t, "tf": rng.randint(1, 4)} for t in {f"w{int(rng.paretovariate(0.5)) % 90}" for _ in range(rng.randint(0, 40))}] for _ in range(300)]
    counts += [counts[7]] * 5  # ties
    tokens = pa.table({"shard": pa.array([0] * 305, pa.int32()), "chunk_id": [3 * i for i in range(305)], "dl": pa.array([sum(c["tf"] for c in x) for x in counts], pa.int64()), "counts": pa.array(counts, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))})
    table = blocks._shard_rows((pa.scalar(0),), tokens, 16)
    names = pa.array([f"w{i}" for i in range(120)])
    terms, begin = np.array([rng.randrange(120) for _ in range(700)]), np.array([0, 2, 100, 100, 400, 700])
    terms = np.concatenate([np.unique(terms[a:b]) for a, b in zip(begin[:-1], begin[1:])])
    begin = np.concatenate([[0], np.flatnonzero(np.diff(terms) <= 0) + 1, [len(terms)]])
    asked = (list(range(len(begin) - 1)), begin, terms, np.array([rng.random() * 5 for _ in terms]))
    monkeypatch.setattr(blocks, "COMMON_NUMBERS", numbers)
    monkeypatch.setattr(blocks, "TOGETHER", 2)
    for dead in (None, pa.table({"chunk_id": [3 * i for i in range(0, 305, 4)]}), pa.table({"chunk_id": [3 * i for i in range(305)]})):
        got = []
        for long in (1, 1000):
            monkeypatch.setattr(blocks, "LONG", long)
            work = blocks._searching(asked, names, 9, 30.0, 1.5, 0.75, pa.int64(), 16)
            rows = sorted(work((pa.scalar(0),), table, dead).to_pylist(), key=lambda r: (r["query_id"], -(r["score"] or 0), r["chunk_id"] or 0))
            got.append([(r["query_id"], r["chunk_id"], r["score"]) for r in rows])
        assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]] and [x[2] for x in got[0]] == pytest.approx([x[2] for x in got[1]], abs=2e-9)
        assert len(got[0]) > 30 or (dead is not None and len(dead) == 305 and not got[0])
