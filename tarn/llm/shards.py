"""Sharding by proportional stratified interleaving.

The rows of each stratum (source) are put in a seeded random order and get the fraction
(rank + 1/2) / rows of the stratum. All rows sorted by that fraction interleave the strata in
proportion at every place, so equal cuts of the order are shards that all match the mixture.

Both ranks are taken without sorting a whole stratum or table in one task. The random key is cut
into equal ranges ("cells") whose number follows the row count; counts of cells, summed in order,
give each cell's first rank, and only rows of one cell are ranked by a window. Fractions are spread
evenly by construction, and keys by hashing, so no cell is hot whatever the sizes of the strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.shared import written

CELL_ROWS = 5_000
#: Cells whose counts are summed in one task.
BLOCK_CELLS = 1_000
SEED = 20_240_601


def seeded_key(identity: list[Column], seed: int) -> Column:
    """Random but repeatable order key: the md5, as hex digits, of the seed and the identity; null as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in identity)))


def _first_ranks(rows: DataFrame, over: list[str], cell: str) -> DataFrame:
    """Rows before each cell (within ``over``), from counts that are taken before the shuffle."""
    counts = rows.groupBy(*over, cell).count().withColumn("block", F.expr(f"`{cell}` div {BLOCK_CELLS}"))
    blocks = counts.groupBy(*over, "block").agg(F.sum("count").alias("n"))
    order = Window.partitionBy(*over).orderBy("block")
    blocks = blocks.select(*over, "block", (F.sum("n").over(order) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy(*over, "block").orderBy(cell)
    before = F.col("earlier") + F.sum("count").over(inside) - F.col("count")
    return counts.join(blocks, [*over, "block"]).select(*over, cell, before.alias("before"))


def stratified_shards(documents: DataFrame, n_shards: int = 8, stratum: str = "source", identity: str = "doc_id", seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Put every row into one of ``n_shards`` shards whose sizes differ by one row at most and whose
    mixtures of strata equal the whole's as nearly as rounding lets them.

    Returns the input's columns, then ``shard`` (int from 0) and ``slot`` (long, the row's place in
    its shard, gapless from 0); input columns of these names are replaced. A null stratum is a
    stratum of its own. The random order is that of md5(seed:identity), and of a hash of the whole row
    where the identity is null, so that many such rows spread like others; rows that are equal in this
    too (repeats) stay next to each other in an arbitrary order. Texts play no part, so equal texts may
    part. An empty table gives an empty table.
    """
    documents = documents.drop(*({"shard", "slot"} & set(documents.columns)))
    names = documents.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row") if names else F.struct().alias("row")
    # a null stratum gets a name that no other can have
    of = F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit(""))
    own = F.col(f"`{identity}`")
    key = F.when(own.isNull(), seeded_key([F.lit(""), F.xxhash64(*(F.col(f"`{c}`") for c in names))], seed)).otherwise(seeded_key([own], seed))
    keyed = documents.select(whole, of.alias("stratum"), key.alias("key"))
    total = documents.count()
    cells = max(1, total // cell_rows)
    keyed = keyed.withColumn("cell", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * cells / F.lit(2**32)).cast("long"))
    sizes = keyed.groupBy("stratum").agg(F.count("*").alias("size"))
    starts = _first_ranks(keyed, ["stratum"], "cell").join(sizes, "stratum")
    ranked = keyed.withColumn("own", F.row_number().over(Window.partitionBy("stratum", "cell").orderBy("key"))).join(starts, ["stratum", "cell"])
    # (2 * rank + 1) / (2 * size), the rank counted from 0
    placed = ranked.select("row", "stratum", "key", ((2 * (F.col("before") + F.col("own")) - 1) / (2 * F.col("size"))).alias("fraction"))
    placed = written(placed, "interleaved").withColumn("cell", F.floor(F.col("fraction") * cells).cast("long"))
    order = Window.partitionBy("cell").orderBy("fraction", "stratum", "key")
    at = F.col("before") + F.col("own") - 1
    numbered = placed.withColumn("own", F.row_number().over(order)).join(_first_ranks(placed, [], "cell"), "cell").select("row", at.alias("place"))
    # shard s holds the places from ceil(s * total / n) on
    shard = F.expr(f"(place * {n_shards}L) div {max(1, total)}L")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return numbered.withColumn("shard", shard).withColumn("slot", F.col("place") - first).select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, tasks_per_shard: int = 1) -> None:
    """Write the shards as Parquet folders ``shard=N``, each file in slot order."""
    ranges = max(1, sharded.agg(F.max("shard")).first()[0] or 0) + 1
    sharded.repartitionByRange(ranges * tasks_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
