"""A growing index against full rebuilds."""

import random

import pytest

from tarn.operators import blocks, bm25, segments
from tarn.plans.engine import Engine
from tarn.plans.settings import Settings


def rows_of(frame):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in frame.collect())


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_random_changes_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 25)))
    of, root = "chunk_id long, retrieval_text string", str(tmp_path / "bm25")
    held = {i: text() for i in range(60)}
    queries = spark.createDataFrame([(0, "w1 w2 w40"), (1, "w7"), (2, " ".join(f"w{i}" for i in range(60)))], "query_id long, query string")
    bm25.publish(spark.createDataFrame([*held.items()], of), root, "m", 2)
    counts = set()
    for step in range(5):
        gone = dict(rng.sample(sorted(held.items()), 6 if step else 30))
        for i in gone:
            del held[i]
        new = {i: text() for i in [*list(gone)[:3], *range(100 * step + 100, 100 * step + 103)]}  # three come back changed
        held |= new
        bm25.grow(spark.createDataFrame([*new.items()], of), spark.createDataFrame([*gone.items()], of), root, "m", 2)
        index = bm25.load(spark, root, "m", 2)
        counts.add(len(index.segments))
        full = bm25.build_index(spark.createDataFrame([*held.items()], of))
        assert {tuple(r) for r in index.term_stats.collect()} == {tuple(r) for r in full.term_stats.collect()}
        assert tuple(index.corpus_stats.first()) == pytest.approx(tuple(full.corpus_stats.first()))
        same(rows_of(blocks.bm25_topk(queries, index, 10)), rows_of(bm25.bm25_topk(queries, full, 10)))
    assert max(counts) > 1 and max(counts) < 6  # some were merged


def test_when_segments_merge():
    sized = lambda *sizes: [{"rows": n, "gone": 0} for n in sizes]
    assert [segments.to_merge(sized(*s)) for s in ((100,), (100, 10), (100, 10, 4), (100, 10, 5), (20, 10), (100, 30, 10, 5, 5))] == [1, 2, 3, 1, 0, 0]


def test_an_engine_updates_what_its_tables_changed(spark, tmp_path):
    engine = Engine(spark, Settings(root=str(tmp_path / "e"), embedding_dimensions=8, buckets=4))
    take = lambda **texts: engine.ingest_texts(spark.createDataFrame([(f"{n}.md", f"# {n}\n\n{t}\n") for n, t in texts.items()], "source_path string, text string"), "r", "c", "en")
    take(**{f"p{i}": f"alpha word{i}" for i in range(12)})
    assert engine.update_bm25()["added"] is None  # there was no index
    assert engine.update_bm25() | {"seconds": 0} == {"generation": engine.update_bm25()["generation"], "chunks": 12, "seconds": 0, "added": 0, "removed": 0}
    take(p3="beta new", q="alpha fresh")
    done = engine.update_bm25()
    assert (done["added"], done["removed"], done["chunks"]) == (2, 1, 13) and len(engine.reload_bm25().segments) == 2
    queries = spark.createDataFrame([(0, "alpha"), (1, "word3"), (2, "beta fresh")], "query_id long, query string")
    grown = rows_of(blocks.bm25_topk(queries, engine.reload_bm25(), 20))
    engine.rebuild_bm25()
    same(grown, rows_of(blocks.bm25_topk(queries, engine.reload_bm25(), 20)))
    assert {q for q, *_ in grown} == {0, 2}
