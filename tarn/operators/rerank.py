"""Second scoring of the best fused candidates, the final ranking, and how sure the first place is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import terms

#: (queries, texts) of one Arrow batch to as many finite scores.
Scorer = Callable[[list[str], list[str]], list[float]]


def overlap_score(query: str, text: str):
    """A stand-in scorer without a model, as an expression: the share of the query's different terms
    that the text has, on a scale from -10 to 10. It says nothing about a model's quality."""
    asked = F.array_distinct(terms(F.col(query)))
    share = F.try_divide(F.size(F.array_intersect(asked, terms(F.col(text)))), F.size(asked))
    return F.coalesce(20.0 * share - 10.0, F.lit(-10.0))


def rerank(candidates: DataFrame, top_k: int, scorer: Scorer | None = None, query: str = "query", text: str = "retrieval_text") -> DataFrame:
    """The first ``top_k`` candidates of each query by rrf_rank, with rerank_score and rerank_rank.

    The cut comes before the scorer, which sees whole Arrow batches in the executors; without one the
    overlap of terms is the score. Ties keep the fused order."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    head = candidates.filter(F.col("rrf_rank") <= top_k)
    if scorer is None:
        scored = head.withColumn("rerank_score", overlap_score(query, text))
    else:

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, texts in batches:
                got = pd.Series(scorer(queries.tolist(), texts.tolist()), dtype="float64")
                if len(got) != len(texts) or not got.map(lambda x: x == x and abs(x) != float("inf")).all():
                    raise ValueError("a scorer must give one finite score for each text")
                yield got

        scored = head.withColumn("rerank_score", score(F.col(query), F.col(text)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rrf_rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order))


def final_topk(ranked: DataFrame, k: int, by: str) -> DataFrame:
    """The first k rows of each query by the rank column ``by``, numbered anew in final_rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy("query_id").orderBy(by)
    return ranked.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)


def confidence(queries: DataFrame, final: DataFrame, threshold: float, reranked: bool = True) -> DataFrame:
    """For each query (query_id): status, score, threshold. ``low`` if the first place's rerank_score is
    below the threshold, else ``not_flagged``; ``unassessed`` without results or reranking. No result
    is ever removed for it."""
    asked = queries.select("query_id").distinct()
    if not reranked:
        return asked.select("query_id", F.lit("unassessed").alias("status"), F.lit(None).cast("double").alias("score"), F.lit(float(threshold)).alias("threshold"))
    top = final.filter("final_rank = 1").select("query_id", F.col("rerank_score").alias("score"))
    status = F.when(F.col("score").isNull(), "unassessed").when(F.col("score") < threshold, "low").otherwise("not_flagged")
    return asked.join(top, "query_id", "left").select("query_id", status.alias("status"), "score", F.lit(float(threshold)).alias("threshold"))
