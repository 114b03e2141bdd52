"""Incremental ingestion as table operations: what changed, the next snapshot, what goes.

There is no row-by-row writing. A snapshot and a batch of new rows are joined on the natural key, and
the next snapshot is written beside the old one, so a failed run leaves the current one as it was.

Where a table lies in buckets, by a hash of the document's key, only the buckets that a batch touches are
joined and written. An id then says its bucket: it is a number of the bucket's own times their number, plus
the bucket's. So buckets are numbered by themselves, and a row is found by its id without a search.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.shared import written

DOCUMENT_KEY = ("source_repo", "source_commit", "source_path")
CHUNK_KEY = ("document_id", "chunk_index")
#: A chunk keeps its vector while all of these stay.
REUSE = ("content_hash", "chunker_version", "embedding_model", "embedding_dimensions")


def with_new_ids(rows: DataFrame, key: Sequence[str], identity: str, first: int) -> DataFrame:
    """Number the rows from ``first`` on in order of their key. Ranges are numbered side by side: a
    window inside each range, plus the counts of the ranges before it. The ranges are written, so that
    numbers and counts see the same ones."""
    ordered = written(rows.repartitionByRange(*key).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*key))
    numbered = ordered.withColumn("__own", own).join(F.broadcast(before), "__part")
    return numbered.withColumn(identity, (F.col("__before") + F.col("__own") - 1 + first).cast("long")).drop("__part", "__own", "__before")


def changed_chunks(new: DataFrame, current: DataFrame, key: Sequence[str] = CHUNK_KEY, reuse: Sequence[str] = REUSE) -> DataFrame:
    """``new`` with is_changed: false where ``current`` has the key with equal ``reuse`` columns."""
    old = current.select(*key, *(F.col(c).alias(f"__{c}") for c in reuse), F.lit(True).alias("__there"))
    same = F.col("__there")
    for c in reuse:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = new.join(old, list(key), "left")
    return joined.withColumn("is_changed", ~F.coalesce(same, F.lit(False))).drop("__there", *(f"__{c}" for c in reuse))


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """The bucket of a document, by its natural key."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def bucket_of_id(identity: str, buckets: int) -> Column:
    return F.pmod(F.col(identity), F.lit(buckets)).cast("int")


def with_bucket_ids(rows: DataFrame, key: Sequence[str], identity: str, bucket: Column, buckets: int, current: DataFrame) -> DataFrame:
    """Number the rows in order of their key after the greatest id of their bucket in ``current``. A batch's
    rows of one bucket are numbered in one task; buckets are dealt by a hash."""
    greatest = current.groupBy(bucket_of_id(identity, buckets).alias("__bucket")).agg(F.max(F.expr(f"`{identity}` div {buckets}")).alias("__last"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(*key))
    numbered = rows.withColumn("__bucket", bucket).withColumn("__own", own).join(greatest, "__bucket", "left")
    value = (F.coalesce(F.col("__last"), F.lit(-1)) + F.col("__own")) * F.lit(buckets).cast("long") + F.col("__bucket")
    return numbered.withColumn(identity, value.cast("long")).drop("__bucket", "__own", "__last")


def upsert(
    current: DataFrame, new: DataFrame, key: Sequence[str], identity: str | None = None, keep: Sequence[str] = (), update: Sequence[str] | None = None,
    numbered: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The next snapshot: rows of ``new`` replace those of ``current`` with the same key, others stay.

    ``identity`` and the columns of ``keep`` survive a replacement; a new key gets the next ids after
    the greatest, or what ``numbered`` makes of the added rows. ``new`` must have one row to a key and all
    columns but ``identity``. ``update`` limits the replaced columns to these."""
    columns = [c for c in current.columns]
    stays = {*key, *keep, *([identity] if identity else [])}
    replaced = [c for c in columns if c not in stays and (update is None or c in update)]
    fresh = new.select(*key, *(F.col(c).alias(f"__{c}") for c in columns if c not in {*key, identity}), F.lit(True).alias("__new"))
    old = current.withColumn("__old", F.lit(True))
    both = old.join(fresh, list(key), "full_outer")

    def value(c: str) -> Column:
        if c in key or c == identity:
            return F.col(c)
        from_new = F.col("__new").isNotNull() & (F.col("__old").isNull() | F.lit(c in replaced))
        return F.when(from_new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    merged = both.select(*(value(c) for c in columns), F.col("__old").isNull().alias("__added"))
    if identity is None:
        return merged.drop("__added")
    kept, added = merged.filter(~F.col("__added")).drop("__added"), merged.filter("__added").drop("__added", identity)
    added = numbered(added) if numbered else with_new_ids(added, key, identity, (current.agg(F.max(identity)).first()[0] or 0) + 1)
    return kept.unionByName(added.select(*columns))


def without_stale(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chunks less those at or beyond their document's new number of chunks in ``sizes`` (document_id,
    n_chunks); documents that ``sizes`` does not name stay whole."""
    stale = chunks.select("document_id", "chunk_index").join(sizes, "document_id").filter("chunk_index >= n_chunks")
    return chunks.join(stale.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti")


def stale_chunks(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    return chunks.join(sizes, "document_id").filter("chunk_index >= n_chunks").drop("n_chunks")


def per_document(judged: DataFrame, batch_size: int, by: Sequence[str] = ("document_id",)) -> DataFrame:
    """What the chunks of ``changed_chunks`` come to for each document: ``chunks``, ``embedded``, ``skipped``,
    and ``requests``, the embedding requests of ``batch_size`` texts that its changed chunks fill, the last
    one in part."""
    counts = judged.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_if("is_changed").alias("embedded"))
    return counts.withColumns({"skipped": F.col("chunks") - F.col("embedded"), "requests": F.expr(f"(embedded + {batch_size - 1}) div {batch_size}")})


def totals(per_document: DataFrame) -> DataFrame:
    """One row: the number of documents and the sums of their counters."""
    counters = [f.name for f in per_document.schema if f.name not in (*DOCUMENT_KEY, "document_id")]
    return per_document.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))
