"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target number of words: its share of the total by weight, but never over ``limit`` times
what it holds; what it cannot use is shared out again among the others. A target is taken in passes. The
budget of pass j is what the target leaves after j whole passes over the source, so budgets are nested:
whatever is in a later pass is in all earlier ones.

A document has a seeded hash as its place, and a pass takes the documents whose place lies below the
budget's threshold. Thresholds are found without sorting. Sizes are summed by source and the first DIGITS
hex digits of the place, which makes few sums a source, before any shuffle. The bucket in which the running
sum crosses the budget is the boundary; only its rows are summed again, by their next digits, until the
boundary is one row. That row is taken if it brings the sum nearer to the budget. A round reads a
4,096th of the rows of the one before, a hot source costs no more than any other, and the choice itself is
one comparison a row.

A place is a string of hex digits: a hash of the seed and the identity, then one of the whole row, then the
row's number in a written table. The later ones count only where the earlier ones tie, so the number tells
apart nothing but equal rows, and another run takes equally many of those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.upsert import with_new_ids
from tarn.shared import discard, written

SEED = 20_240_601
#: Hex digits that one round of sums tells apart, and those of the identity's hash in a place.
DIGITS, IDENTITY_DIGITS = 3, 15
#: Comes after all hex digits.
END = "g"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
LIMIT = 3
_WHOLE = "decimal(38,0)"


def n_words(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def place(documents: DataFrame, identity: str, seed: int) -> Column:
    """Where each row stands in its source's order; a row without identity is placed by its content."""
    row = F.hex(F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns))) if documents.columns else F.lit("")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{identity}`").cast("string"), F.concat(F.lit("-"), row)))
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return F.concat(F.substring(F.md5(named), 1, IDENTITY_DIGITS), F.lower(F.lpad(row, 16, "0")), F.lower(number))


def cyclic_weights(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(of, size, weight) of (of, size): the weights in turn, over the sources by code point, null last."""
    ordered = with_new_ids(sources.withColumn("last", F.col("of") == ""), ["last", "of"], "number", 0)
    each = F.array(*(F.lit(int(w)) for w in weights))
    return ordered.select("of", "size", F.get(each, (F.col("number") % len(weights)).cast("int")).cast("long").alias("weight"))


def targets(sources: DataFrame, total: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(of, size, target) of (of, size, weight): ``total`` (by default all sizes) by weight, no target over
    ``limit`` times the size, the excess reshared. The driver sees sums only. Every round settles all
    sources that are over their limit."""
    open_, settled = sources.withColumn("most", F.col("size") * limit), None
    left = int((sources.agg(F.sum("size")).first()[0] or 0) if total is None else total)
    while True:
        weight = int(open_.agg(F.sum("weight")).first()[0] or 0)
        over = F.col("most").cast(_WHOLE) * F.lit(weight) < F.col("weight").cast(_WHOLE) * F.lit(left)
        full = open_.filter(over).select("of", "size", "most")
        used = full.agg(F.sum("most")).first()[0] if weight else None
        if used is None:
            share = open_.select("of", "size", (F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(max(1, weight)))).alias("target"))
            return share if settled is None else share.unionByName(settled)
        full = written(full, "full").select("of", "size", F.col("most").cast("double").alias("target"))
        settled = full if settled is None else settled.unionByName(full)
        open_ = written(open_.filter(~over), "open")
        left -= int(used)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(of, pass, bound) for each (of, pass, budget) of ``budgets`` whose source has words: the rows (of,
    size, place) of the source with place < bound sum nearest to the budget; of two equally near sums the
    larger one. A source without words has no row."""
    rows = rows.filter("size > 0").select("of", "size", "place")
    state, by, found, used = budgets.select("of", "pass", F.col("budget").alias("left"), F.lit("").alias("prefix")), ["of"], None, []
    at = 1
    while True:
        digits = rows.groupBy(*by, F.substring("place", at, DIGITS).alias("digits")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        before = F.sum("n").over(Window.partitionBy(*by).orderBy("digits")) - F.col("n")  # 4,096 rows a window
        sums = written(digits.withColumn("before", before).join(state, by), "sums")
        crosses = F.col("before").cast("double") < F.col("left"), F.col("left") < (F.col("before") + F.col("n")).cast("double")
        fits = (F.col("before") + F.col("n")).cast("double") <= F.col("left")
        ends = sums.groupBy("of", "pass", "prefix").agg(F.max(F.when(fits, F.col("digits"))).alias("last"), F.count_if(crosses[0] & crosses[1]).alias("open"))
        even = ends.filter("open = 0").select("of", "pass", F.concat("prefix", F.coalesce(F.concat("last", F.lit(END)), F.lit(""))).alias("bound"))
        boundary = sums.filter(crosses[0] & crosses[1])
        nearer = F.col("before") + F.col("n") - F.col("left") <= F.col("left") - F.col("before")
        single = boundary.filter("rows = 1").select("of", "pass", F.concat("prefix", "digits", F.when(nearer, F.lit(END)).otherwise(F.lit(""))).alias("bound"))
        found = even.unionByName(single) if found is None else found.unionByName(even).unionByName(single)
        wide = boundary.filter("rows > 1").select("of", "pass", (F.col("left") - F.col("before")).alias("left"), F.concat("prefix", "digits").alias("prefix"))
        if wide.isEmpty():
            return found
        inner = rows.join(wide.select(*by, *(["pass"] if by == ["of"] else []), "prefix"), by)
        inner = written(inner.filter(F.startswith("place", "prefix")).select("of", "pass", "size", "place"), "boundary")
        discard(*used)
        rows, state, by, used, at = inner, wide, ["of", "pass"], [inner], at + DIGITS


def mix_sources(
    documents: DataFrame, keep: Sequence[str], weights: Sequence[int] | DataFrame = WEIGHTS, total: int | None = None, limit: int = LIMIT,
    text: str = "text", source: str = "source", identity: str = "doc_id", seed: int = SEED, into: str = "mix",
) -> DataFrame:
    """How often the mix takes each document.

    Returns a row for each row: the columns named in ``keep``, which are written once, and the struct
    ``into``: size (words of the whole text), source_size, target (its source's, in words), copies (0 to
    ``limit``) and taken (copies times size). ``weights`` are dealt over the sources in order of code points,
    null last, or come as a table (source, weight) of whole numbers, in which a source that is missing
    weighs nothing. A null source is a source of its own, a null text has no words; documents without words
    are taken as often as their place says and count nothing. The sum of a source is off its target by half
    the size of one document a pass at most. Rows that share an identity, and equal rows, are told apart as
    the module says. The kept columns may have any names. An empty table gives an empty table.
    """
    of = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    kept = F.struct(*(F.col(f"`{c}`") for c in keep))
    rows = written(documents.select(kept.alias("row"), of.alias("of"), n_words(F.col(f"`{text}`")).alias("size"), place(documents, identity, seed).alias("place")), "placed")
    sizes = written(rows.groupBy("of").agg(F.sum("size").alias("size")), "sizes")
    if isinstance(weights, DataFrame):
        named = weights.select(F.coalesce(F.concat(F.lit("="), F.col(weights.columns[0]).cast("string")), F.lit("")).alias("of"), F.col(weights.columns[1]).cast("long").alias("weight"))
        weighed = sizes.join(named, "of", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    else:
        weighed = cyclic_weights(sizes, weights)
    goals = written(targets(weighed, total, limit), "targets")
    budget = F.least(F.col("size").cast("double"), F.greatest(F.lit(0.0), F.col("target") - F.col("pass") * F.col("size")))
    budgets = goals.select("of", "size", "target", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))).alias("pass")).select("of", "pass", budget.alias("budget"))
    bounds = thresholds(rows, budgets).groupBy("of").agg(F.collect_list("bound").alias("bounds"))
    by_source = written(goals.withColumnRenamed("size", "source_size").join(bounds, "of", "left"), "bounds")
    # a row a source on the right; rows of a hot source are split at run time where that is no broadcast
    copies = F.coalesce(F.size(F.filter("bounds", lambda b: F.col("place") < b)), F.lit(0))
    copies = F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(copies)
    judged = rows.join(by_source, "of").withColumn("copies", copies)
    return judged.select("row.*", F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")).alias(into))


def repeated(mixed: DataFrame, into: str = "mix", copy: str = "copy") -> DataFrame:
    """The mix itself: each row as often as it is taken, numbered from 0 in the column ``copy``."""
    columns = [F.col(f"`{c}`") for c in mixed.columns if c not in (into, copy)]
    return mixed.filter(F.col(f"`{into}`.copies") > 0).select(*columns, F.explode(F.sequence(F.lit(0), F.col(f"`{into}`.copies") - 1)).alias(copy))
