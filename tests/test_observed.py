"""Counts and reads of a search come from the jobs that made it."""

import pytest

from tarn.plans.engine import Engine
from tarn.plans.settings import Settings


def jobs(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine(spark, Settings(root=str(tmp_path_factory.mktemp("e")), embedding_dimensions=16, lists=4, buckets=4))
    rows = [(f"p{i}.md", f"# p{i}\n\nword{i} and common words {i % 5}\n") for i in range(30)]
    made.ingest_texts(spark.createDataFrame(rows, "source_path string, text string"), "r", "c", "en")
    made.rebuild_bm25()
    return made


@pytest.mark.parametrize("mode, use_reranker", [("exact", True), ("ann", False)])
def test_counts_start_no_job(spark, engine, mode, use_reranker):
    queries = spark.createDataFrame([(0, "word3 common"), (1, "nothing of it")], "query_id long, query string")
    answer = engine.search(queries, mode, use_reranker, dense_top_k=7, bm25_top_k=5)
    spark.sparkContext.setJobGroup(mode, "counts")
    counts, reads = answer.counts(), dict(answer.reads)
    assert jobs(spark, mode) == 0
    assert counts == {"dense": answer.dense.count(), "bm25": answer.bm25.count(), "union": answer.fused.count(), "results": answer.results.count()}
    assert jobs(spark, mode) > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if mode == "exact":
        assert reads == {"uses_index": False}
    else:
        assert reads["uses_index"] and 0 < reads["codes"] <= 2 * 30 and reads["vectors"] <= 2 * 21 and 1 <= reads["lists"] <= 4
