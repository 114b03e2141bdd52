"""Quality rules with thresholds that the corpus itself sets, in DataFrame expressions only.

Every document is measured row by row. Each measure of the documents that pass the base rules goes
into a quantile sketch per language and source: a log-linear histogram (32 buckets for each power of
two, so a quantile is off by at most 1/32 of its value) held as rows (group, measure, bucket, count).
Sketches merge by adding counts, so they are summed before any shuffle, a hot source costs no more
than a rare one, and the sketch of a language, or of all, is the sum of its sources' sketches.

A group's quantiles come from its own sketch and PRIOR_ROWS further rows that are spread like its
language (a language's likewise from all languages). So a small group judges much like its language and
a large one by itself, with every shade between.

A group's fence is its TAIL quantile plus ``reach`` times the distance from the median to it: no number of
it is given, so a group that is spread otherwise has another fence, and up to a tenth of junk does not
move it. It lies at most LIMIT times as far as the language's, so a source of nothing but junk cannot
move its own fence out of reach. The fences are joined to the measured rows by language and source.

A document is kept if no measure lies beyond its group's fence by more than the noise of counting: a count c
that comes in units of u words or lines scatters by the root of u * c, and Z such roots are allowed. So one
symbol in a short text is no verdict where most texts have none, and the same share in a long one is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.shared import written

#: measure: (count, size, scale, unit): the value is scale * count / size in whole numbers; counts come in
#: units (five words that stand twice are ten)
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, 10),
    "long_words": ("word_chars", "n_words", 100, 1),
    "short_words": ("n_words", "word_chars", 10000, 1),
}
#: The quantile, in tenths, that a group's clean documents reach.
TAIL = 9
REACH = 4
LIMIT = 3
#: Standard deviations of a count.
Z = 3
#: Rows of the coarser group that count with a group's own.
PRIOR_ROWS = 200
#: Counts are kept in parts of a row, as whole numbers.
PARTS = 100

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
_SPACE = r"[\\x20\\x09-\\x0D]"


def base_counts(documents: DataFrame, text: str, into: str) -> DataFrame:
    """``documents`` with a struct column ``into`` of the base counts of the whole text (null: none).

    n_words, word_chars, n_symbols, n_dup_lines, n_lines (lines with a word), n_repeat_words; longs.
    Windows of five words are compared by a 64-bit hash within one text.
    """
    # one projection a step, so that each array is built once
    rows = documents.withColumn("__t", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = rows.withColumn("__w", F.expr(f"filter(split(__t, '{_SPACE}+'), x -> x != '')"))
    rows = rows.withColumn("__l", F.expr(r"filter(split(__t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    rows = rows.withColumn("__h", F.expr("case when size(__w) >= 5 then transform(sequence(1, size(__w) - 4), i -> xxhash64(slice(__w, i, 5))) else cast(array() as array<bigint>) end"))
    # windows sorted by hash, then those equal to a neighbour, back in the order of the text
    rows = rows.withColumn("__s", F.expr("case when size(array_distinct(__h)) < size(__h) then sort_array(transform(__h, (h, i) -> struct(h, i))) else cast(array() as array<struct<h:bigint,i:int>>) end"))
    rows = rows.withColumn("__p", F.expr("sort_array(transform(filter(__s, (s, i) -> s.h <=> get(__s, i - 1).h or s.h <=> get(__s, i + 1).h), s -> s.i))"))
    counts = {
        "n_words": "cast(size(__w) as long)",
        "word_chars": "cast(length(array_join(__w, '')) as long)",
        "n_symbols": "cast(length(__t) - length(regexp_replace(__t, '[#*$%&|<>]', '')) as long)",
        "n_dup_lines": "cast(size(__l) - size(array_distinct(__l)) as long)",
        "n_lines": "cast(size(__l) as long)",
        "n_repeat_words": "aggregate(transform(__p, (p, i) -> least(5, coalesce(get(__p, i + 1) - p, 5))), 0L, (a, x) -> a + x)",
    }
    return rows.withColumn(into, F.struct(*(F.expr(v).alias(k) for k, v in counts.items()))).drop("__t", "__w", "__l", "__h", "__s", "__p")


def base_failed(counts: str) -> Column:
    return F.expr(f"{counts}.n_words < 10 or 100 * {counts}.n_repeat_words > 20 * {counts}.n_words")


def bucket_of(value: Column) -> Column:
    """Log-linear bucket of a non-negative whole number: itself below 64, then 32 to a power of two."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return (shift * 32 + F.shiftright(value, 0) / F.pow(F.lit(2.0), shift)).cast("long")


def bucket_top(bucket: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.greatest(F.lit(0), F.floor(bucket / 32) - 1).cast("long")
    return ((bucket - shift * 32 + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1


def sketches(measured: DataFrame, group: Sequence[str], counts: str) -> DataFrame:
    """Rows (group..., measure, bucket, n): a mergeable quantile sketch of each measure for each group."""
    values = F.create_map(*(x for name, (count, size, scale, _) in MEASURES.items() for x in (F.lit(name), bucket_of(F.expr(f"{counts}.{count} * {scale} div {counts}.{size}")))))
    rows = measured.filter(~base_failed(counts)).select(*group, F.explode(values).alias("measure", "bucket"))
    return rows.groupBy(*group, "measure", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, group: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups: counts added."""
    return sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))


def is_beyond(name: str, counts: str, fence: Column) -> Column:
    """Whether a measure lies beyond the fence by more than the noise of its count."""
    count, size, scale, unit = MEASURES[name]
    excess = F.col(f"{counts}.{count}").cast("double") * scale - fence.cast("double") * F.col(f"{counts}.{size}").cast("double")
    return (excess > 0) & (excess * excess > F.lit(float((Z * scale) ** 2 * unit)) * F.col(f"{counts}.{count}").cast("double"))


def blended(own: DataFrame, coarser: DataFrame | None, group: Sequence[str], above: Sequence[str], prior_rows: int) -> DataFrame:
    """Rows (group..., measure, bucket, weight): the sketch ``own`` (with counts n) in parts of rows, plus
    prior_rows rows that are spread like ``coarser``, which has its weights by the columns ``above``."""
    weighed = own.select(*group, "measure", "bucket", (F.col("n") * PARTS).alias("weight"))
    if coarser is None:
        return weighed
    total = F.sum("weight").over(Window.partitionBy(*above, "measure"))
    share = coarser.withColumn("total", total).select(*above, "measure", "bucket", F.expr(f"weight * {prior_rows * PARTS} div total").alias("weight"))
    lent = own.select(*group, "measure").distinct().join(share, [*above, "measure"]).select(*group, "measure", "bucket", "weight")
    return weighed.unionByName(lent).groupBy(*group, "measure", "bucket").agg(F.sum("weight").alias("weight"))


def fences(sketch: DataFrame, group: Sequence[str], reach: int) -> DataFrame:
    """Rows (group..., measure, fence)."""
    own = Window.partitionBy(*group, "measure")
    summed = sketch.withColumn("up_to", F.sum("weight").over(own.orderBy("bucket"))).withColumn("all", F.sum("weight").over(own))
    least = [F.min(F.when(F.col("up_to") * 10 >= F.col("all") * q, bucket_top(F.col("bucket")))).alias(name) for q, name in ((5, "mid"), (TAIL, "high"))]
    fence = (F.col("high") + reach * (F.col("high") - F.col("mid"))).cast("long")
    return summed.groupBy(*group, "measure").agg(*least).select(*group, "measure", fence.alias("fence"))


def quality_rules(
    documents: DataFrame, keep: Sequence[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source",
    reach: int = REACH, prior_rows: int = PRIOR_ROWS, into: str = "quality",
) -> DataFrame:
    """Measure, sketch, and judge ``documents``.

    Returns a row for each row: the columns named in ``keep`` (all, if None) and the struct column
    ``into``: the base counts, ``base_failed`` (fewer than 10 words, or over 20 % of the words in
    five-word windows that recur in the text), ``beyond`` (sorted names of the measures past the
    group's fence; empty if base_failed) and ``kept``. Null and empty texts fail the base rules; null
    languages and sources are groups of their own; repeated rows count each for themselves. The
    measured rows, with the kept columns only, are written once, as sketch and join both read them.
    """
    keep = list(documents.columns if keep is None else keep)
    group = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in (lang, source)]
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("text"), group[0].alias("lang"), group[1].alias("source"))
    measured = written(base_counts(rows, "text", "counts").drop("text"), "measured")
    sketch = sketches(measured, ["lang", "source"], "counts")
    sketch = written(sketch, "sketch")
    by_lang = merged(sketch, ["lang"])
    overall = blended(merged(by_lang, []), None, [], [], 0)
    of_lang = blended(by_lang, overall, ["lang"], [], prior_rows)
    of_source = blended(sketch, of_lang, ["lang", "source"], ["lang"], prior_rows)
    bound = fences(of_lang, ["lang"], reach).select("lang", "measure", (LIMIT * F.col("fence")).alias("most"))
    each = fences(of_source, ["lang", "source"], reach).join(bound, ["lang", "measure"])
    pairs = F.array_sort(F.collect_list(F.struct("measure", F.least("fence", "most").alias("fence"))))
    chosen = written(each.groupBy("lang", "source").agg(F.map_from_entries(pairs).alias("fence")), "fences")
    # a row a group on the right: rows of a hot source that do not fit one task are split at run time
    joined = measured.join(chosen, ["lang", "source"], "left")
    failed = base_failed("counts")
    beyond = F.array_sort(F.array_compact(F.array(*(F.when(is_beyond(name, "counts", F.col("fence")[name]), F.lit(name)) for name in MEASURES))))
    beyond = F.when(failed, F.array().cast("array<string>")).otherwise(beyond)
    judged = joined.withColumn("beyond", beyond)
    verdict = F.struct("counts.*", failed.alias("base_failed"), F.col("beyond"), (~failed & (F.size("beyond") == 0)).alias("kept"))
    return judged.select("row.*", verdict.alias(into))
