"""Retrieval quality: first relevant rank, Recall@k, MRR and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.shared import written

DEPTH = 10


def relevant(source_path: Column, heading_path: Column, path_hints: Column, heading_hints: Column) -> Column:
    """Whether the path, or the heading path joined by `` / ``, holds one of its hints, in any case."""
    path, heading = F.lower(source_path), F.lower(F.array_join(heading_path, " / "))
    none = F.array().cast("array<string>")
    hit = lambda text, hints: F.exists(F.coalesce(hints, none), lambda h: F.coalesce(F.contains(text, F.lower(h)), F.lit(False)))
    return hit(path, path_hints) | hit(heading, heading_hints)


def first_relevant_rank(queries: DataFrame, hits: DataFrame, by: list[str], depth: int = DEPTH) -> DataFrame:
    """(by..., query_id, first_rank) for each query of ``queries`` and each combination of ``by`` in
    ``hits`` (by..., query_id, rank, is_relevant); null where none of the first ``depth`` is relevant."""
    found = hits.filter(F.col("rank") <= depth).groupBy(*by, "query_id").agg(F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("first_rank"))
    asked = queries.select("query_id").distinct()
    if by:
        asked = asked.crossJoin(F.broadcast(hits.select(*by).distinct()))  # a few names of methods
    return asked.join(found, [*by, "query_id"], "left")


def quality(first_ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_queries, recall_5, recall_10, mrr_10): shares of queries with a relevant result among
    the first 5 and 10, and the mean of 1 / first rank, which counts 0 where there is none."""
    rank = F.col("first_rank")
    share = lambda k: F.avg(F.when(rank <= k, 1.0).otherwise(0.0))
    return first_ranks.groupBy(*by).agg(F.count("*").alias("n_queries"), share(5).alias("recall_5"), share(10).alias("recall_10"), F.avg(F.when(rank <= 10, 1.0 / rank).otherwise(0.0)).alias("mrr_10"))


def latency(measured: DataFrame, by: list[str], column: str = "latency_ms") -> DataFrame:
    """(by..., mean_ms, p95_ms); the percentile is exact and interpolates. Null values do not count.

    Equal values are counted first; their counts, in order over ranges, give every value its ranks, so
    no group has to fit one task."""
    counted = measured.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = written(counted.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()), "latency")
    parts = placed.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"), F.sum(F.col("__n") * F.col("__v")).alias("__s"))
    group = Window.partitionBy(*by)
    before = F.sum("__m").over(group.orderBy("__part")) - F.col("__m")
    parts = parts.select(*by, "__part", before.alias("__before"), F.sum("__m").over(group).alias("__all"), F.sum("__s").over(group).alias("__total"))
    inside = Window.partitionBy(*by, "__part").orderBy("__v")
    ranked = placed.join(parts, [*by, "__part"]).withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
    at = 0.95 * (F.col("__all") - 1)
    value = lambda rank: F.max(F.when((rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__n")), F.col("__v")))
    found = ranked.groupBy(*by).agg(F.max(F.col("__total") / F.col("__all")).alias("mean_ms"), value(F.floor(at)).alias("__low"), value(F.ceil(at)).alias("__high"), F.max(at - F.floor(at)).alias("__share"))
    return found.select(*by, "mean_ms", (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__share")).alias("p95_ms"))
