"""Reciprocal Rank Fusion of a dense and a BM25 ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def first_per_chunk(ranked: DataFrame) -> DataFrame:
    """One row for each query and chunk: its first rank and that row's score. Repeats still take up ranks."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))


def reciprocal_rank_fusion(dense: DataFrame, bm25: DataFrame, constant: int = RANK_CONSTANT, limit: int | None = None) -> DataFrame:
    """Fuse two tables (query_id, rank, chunk_id, score): query_id, rrf_rank, chunk_id, rrf_score and
    each side's rank and score, null where a side has no such chunk. Ties go to the chunk seen first,
    the dense ranking being read before the other."""
    if constant <= 0:
        raise ValueError("the rank constant must be positive")
    sides = [first_per_chunk(t).withColumnsRenamed({"rank": f"{n}_rank", "score": f"{n}_score"}) for n, t in (("dense", dense), ("bm25", bm25))]
    both = sides[0].join(sides[1], ["query_id", "chunk_id"], "full_outer")
    share = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", share("dense_rank") + share("bm25_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), "bm25_rank")
    fused = both.withColumn("rrf_rank", F.row_number().over(order))
    fused = fused if limit is None else fused.filter(F.col("rrf_rank") <= limit)
    return fused.select("query_id", "rrf_rank", "chunk_id", "rrf_score", "dense_rank", "dense_score", "bm25_rank", "bm25_score")
