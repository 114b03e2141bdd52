"""A BM25 index that grows: immutable segments, marks for what is gone, merges by size.

A segment holds the chunks that one change added, in blocks (see ``blocks``), and the ids of the chunks of
earlier segments that it took away. Document frequencies and lengths are kept as changes, so those of the
whole index are sums over its segments: they, the scores and the ranking are what a full rebuild gives. A
changed chunk is taken away and added again under its id.

Segments are merged from the youngest on while one is at most FACTOR times as large as all that are younger,
so there are about as many as the logarithm of the corpus, and a chunk is rewritten as often.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import Segmenter
from tarn.operators import blocks
from tarn.operators.bm25 import tokenized
from tarn.shared import written

FACTOR = 2
TOKENS = "chunk_id long, dl long, counts array<struct<term:string,tf:bigint>>"


@dataclass(frozen=True)
class Segments:
    """What ``blocks.search`` needs of an index, over all its segments (manifest entries, the oldest first)."""

    spark: SparkSession
    segments: list[dict]
    term_stats: DataFrame
    corpus_stats: DataFrame
    block: int = blocks.BLOCK
    _gone: dict[int, DataFrame] = field(default_factory=dict, compare=False)

    def gone_from(self, i: int) -> DataFrame | None:
        """chunk_id of what segments younger than the i-th took away."""
        paths = [f"{s['path']}/gone" for s in self.segments[i + 1 :] if s["gone"]]
        return self.spark.read.schema("chunk_id long").parquet(*paths).distinct() if paths else None

    def parts(self) -> list[tuple[DataFrame, DataFrame | None]]:
        out = []
        for i, s in enumerate(self.segments):
            if not s["rows"]:
                continue
            gone = self.gone_from(i)
            dead = None if gone is None else gone.withColumn("shard", blocks.shard_of(s["shards"]))
            out.append((blocks.load_rows(self.spark, s["path"], s["buckets"]), dead))
        return out

    def tokens(self, first: int) -> DataFrame:
        """Tokenized chunks of the segments from ``first`` on that are still there."""
        out = self.spark.createDataFrame([], TOKENS)
        for i, s in enumerate(self.segments):
            if i >= first and s["rows"]:
                own, gone = self.spark.read.schema(TOKENS).parquet(f"{s['path']}/tokens"), self.gone_from(i)
                out = out.unionByName(own if gone is None else own.join(gone, "chunk_id", "left_anti"))
        return out


def opened(spark: SparkSession, segments: list[dict]) -> Segments:
    stats, sums = "term string, df long", "n long, dl long"
    paths = [s["path"] for s in segments]
    terms = spark.read.schema(stats).parquet(*(f"{p}/term_stats" for p in paths)).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    corpus = spark.read.schema(sums).parquet(*(f"{p}/corpus_stats" for p in paths)).agg(F.sum("n").alias("n"), F.try_divide(F.sum("dl").cast("double"), F.sum("n").cast("double")).alias("avgdl"))
    return Segments(spark, segments, terms, corpus)


def _counted(tokens: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    terms = tokens.select(F.explode("counts.term").alias("term")).groupBy("term").agg((F.count("*") * sign).cast("long").alias("df"))
    return terms, tokens.agg((F.count("*") * sign).cast("long").alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).cast("long").alias("dl"))


def _written(tokens: DataFrame, gone: DataFrame | None, terms: DataFrame, corpus: DataFrame, path: str) -> dict:
    """Write a segment; its entry for the manifest."""
    spark = tokens.sparkSession
    tokens.write.parquet(f"{path}/tokens")
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    terms.write.parquet(f"{path}/term_stats")
    corpus.write.parquet(f"{path}/corpus_stats")
    entry = {"path": path, "rows": tokens.count(), "buckets": 0, "shards": 0, "gone": 0}
    if entry["rows"]:
        rows, entry["shards"] = blocks.posting_rows(tokens)
        entry["buckets"] = blocks.save_rows(rows, entry["shards"], path)
    if gone is not None:
        gone.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct().write.parquet(f"{path}/gone")
        entry["gone"] = spark.read.parquet(f"{path}/gone").count()
    return entry


def added(chunks: DataFrame, path: str, removed: DataFrame | None = None, text: str = "retrieval_text", segmenter: Segmenter | None = None) -> dict:
    """A segment under ``path`` with ``chunks`` (chunk_id, text); ``removed`` has the chunks of earlier segments that
    go, with the texts that they were indexed with. A changed chunk is in both."""
    tokens = tokenized(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), text), text, segmenter).select("chunk_id", "dl", "counts")
    terms, corpus = _counted(tokens, 1)
    if removed is not None:
        old = tokenized(removed.select(F.col("chunk_id").cast("long").alias("chunk_id"), text), text, segmenter).select("chunk_id", "dl", "counts")
        less, fewer = _counted(old, -1)
        terms, corpus = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")), corpus.unionByName(fewer).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
        removed = old
    return _written(tokens, removed, terms, corpus, path)


def to_merge(segments: list[dict]) -> int:
    """The first of the segments that are due to become one with all younger ones; their number if none is."""
    first, younger = len(segments), 0
    for i in range(len(segments) - 1, -1, -1):
        size = segments[i]["rows"] + segments[i]["gone"]
        if i < len(segments) - 1 and size <= FACTOR * younger:
            first = i
        younger += size
    return first


def merged(spark: SparkSession, segments: list[dict], path: str) -> list[dict]:
    """The segments, with those that are due as one under ``path``."""
    first = to_merge(segments)
    if first == len(segments):
        return segments
    index, due = Segments(spark, segments, None, None), segments[first:]
    read = lambda what, schema: spark.read.schema(schema).parquet(*(f"{s['path']}/{what}" for s in due))
    terms = read("term_stats", "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    corpus = read("corpus_stats", "n long, dl long").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    marks = [f"{s['path']}/gone" for s in due if s["gone"]]
    gone = spark.read.schema("chunk_id long").parquet(*marks) if marks and first else None  # before the first there is nothing
    return segments[:first] + [_written(written(index.tokens(first), "merged"), gone, terms, corpus, path)]
