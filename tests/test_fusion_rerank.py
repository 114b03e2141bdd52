"""Fusion, reranking, confidence and ranking differences on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tarn.operators import fusion, rerank, rewrite

RANKED = "query_id long, rank int, chunk_id long, score double"


def ranked(spark, rows):
    return spark.createDataFrame([(0, i + 1, c, s) for i, (c, s) in enumerate(rows)], RANKED)


def test_fusion_order_and_scores(spark):
    dense, sparse = ranked(spark, [(10, 0.91), (20, 0.82), (30, 0.73)]), ranked(spark, [(20, 12.4), (40, 9.1), (10, 7.2)])
    got = fusion.reciprocal_rank_fusion(dense, sparse, 60).orderBy("rrf_rank").collect()
    assert [r["chunk_id"] for r in got] == [20, 10, 40, 30]
    assert got[0]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)
    assert (got[2]["dense_rank"], got[2]["dense_score"], got[2]["bm25_rank"]) == (None, None, 2)


def test_repeats_keep_first_and_take_up_ranks(spark):
    got = fusion.reciprocal_rank_fusion(ranked(spark, [(1, 0.9), (1, 0.8), (2, 0.7)]), ranked(spark, [])).orderBy("rrf_rank").collect()
    assert [(r["chunk_id"], r["dense_rank"], r["dense_score"]) for r in got] == [(1, 1, 0.9), (2, 3, 0.7)]


def test_ties_go_to_the_chunk_seen_first(spark):
    got = fusion.reciprocal_rank_fusion(ranked(spark, [(5, 1.0)]), ranked(spark, [(3, 1.0)])).orderBy("rrf_rank").collect()
    assert [r["chunk_id"] for r in got] == [5, 3]


def test_constant_must_be_positive(spark):
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(ranked(spark, []), ranked(spark, []), 0)


def candidates(spark, order, texts=None):
    return spark.createDataFrame([(0, i + 1, c, "q", (texts or {}).get(c, str(c))) for i, c in enumerate(order)], "query_id long, rrf_rank int, chunk_id long, query string, retrieval_text string")


def test_rerank_sorts_and_cuts(spark):
    scores = {"20": 0.1, "30": 0.9, "10": 0.2}
    got = rerank.rerank(candidates(spark, [20, 30, 10, 40]), 3, lambda queries, texts: [scores[t] for t in texts])
    final = rerank.final_topk(got, 2, "rerank_rank").orderBy("final_rank").collect()
    assert [(r["chunk_id"], r["final_rank"]) for r in final] == [(30, 1), (10, 2)]
    assert got.count() == 3


def test_rerank_ties_keep_the_fused_order(spark):
    got = rerank.rerank(candidates(spark, [7, 3, 5]), 3, lambda q, t: [1.0] * len(t)).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in got] == [7, 3, 5]


@pytest.mark.parametrize("scorer", [lambda q, t: [], lambda q, t: [float("nan")] * len(t)])
def test_bad_scorer_raises(spark, scorer):
    with pytest.raises(Exception, match="finite score"):
        rerank.rerank(candidates(spark, [1]), 1, scorer).collect()


def test_overlap_score_without_scorer(spark):
    got = rerank.rerank(candidates(spark, [1, 2], {1: "nothing", 2: "a Q here"}), 2).orderBy("rerank_rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in got] == [(2, 10.0), (1, -10.0)]


def test_confidence(spark):
    queries = spark.createDataFrame([(q,) for q in range(4)], "query_id long")
    final = spark.createDataFrame([(0, 1, -5.0), (1, 1, -4.0), (2, 1, 3.0), (2, 2, -9.0)], "query_id long, final_rank int, rerank_score double")
    got = {r["query_id"]: r["status"] for r in rerank.confidence(queries, final, -4.0).collect()}
    assert got == {0: "low", 1: "not_flagged", 2: "not_flagged", 3: "unassessed"}
    assert {r["status"] for r in rerank.confidence(queries, final, -4.0, reranked=False).collect()} == {"unassessed"}


def test_ranking_diff(spark):
    a, b = ranked(spark, [(10, 1.0), (20, 1.0), (30, 1.0)]).drop("score"), ranked(spark, [(20, 1.0), (40, 1.0), (10, 1.0)]).drop("score")
    diff = rewrite.ranking_diff(a, b)
    got = diff.orderBy("position").collect()
    assert [(r["chunk_id"], r["rank_without"], r["rank_with"], r["rank_delta"]) for r in got] == [(10, 1, 3, -2), (20, 2, 1, 1), (30, 3, None, None), (40, None, 2, None)]
    assert rewrite.diff_summary(diff).first().asDict() == {"query_id": 0, "n_overlap": 2, "n_only_without": 1, "n_only_with": 1, "same_order": False}
    assert rewrite.diff_summary(rewrite.ranking_diff(a, a)).select(F.first("same_order")).first()[0] is True
