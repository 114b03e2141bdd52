"""Words of texts without spaces (Han runs): a dictionary that the corpus itself gives, and the best cut.

A string of two to LONGEST characters is a word if its parts stand together far more often than by chance
(cohesion: the least pointwise mutual information over all ways to cut it in two) and if much may stand
before and after it (freedom: the lesser entropy of its neighbours). Both come from counts of strings alone,
which are summed by groupBy over the distinct runs, so a common run or string is one row.

A run is cut along the best path through the lattice of its words, that with the greatest product of their
frequencies, by dynamic programming. For search, a word also gives the shorter words in it, and a stretch
of characters that belong to no word gives overlapping pairs, so that a word that the dictionary lacks can
still be found, and only by texts that hold it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.shared import written

LONGEST = 4
MIN_COUNT = 5
MIN_COHESION = 3.0
MIN_FREEDOM = 0.7
#: The most words of a dictionary, as each task holds it; the most frequent ones stay.
MAX_WORDS = 200_000
HAN_RUNS = "[㐀-䶿一-鿿]+"
DIGITS = 9


def string_counts(texts: DataFrame, text: str, longest: int = LONGEST, runs: str = HAN_RUNS) -> DataFrame:
    """(gram, n): how often each string of up to ``longest`` + 1 characters stands in the runs of the texts."""
    found = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(runs), F.lit(0))).alias("run"))
    found = found.groupBy("run").agg(F.count("*").alias("n"))
    grams = f"flatten(transform(sequence(1, {longest + 1}), k -> if(length(run) < k, array(), transform(sequence(1, greatest(length(run) - k + 1, 1)), i -> substring(run, i, k)))))"
    return found.select(F.explode(F.expr(grams)).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def judged_strings(counts: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """(gram, n, cohesion, freedom) of the strings of 2 to ``longest`` characters that stand ``min_count`` times.
    An end of a run is a neighbour of its own each time. ``counts`` is read several times: a written table."""
    size = F.length("gram")
    total = counts.filter(size == 1).agg(F.sum("n")).first()[0] or 0
    grams = counts.filter((size >= 2) & (size <= longest) & (F.col("n") >= min_count))
    cuts = grams.select("gram", "n", F.explode(F.expr("transform(sequence(1, length(gram) - 1), i -> struct(substring(gram, 1, i) as head, substring(gram, i + 1) as tail))")).alias("c")).select("gram", "n", "c.*")
    cuts = cuts.join(counts.select(F.col("gram").alias("head"), F.col("n").alias("n_head")), "head").join(counts.select(F.col("gram").alias("tail"), F.col("n").alias("n_tail")), "tail")
    apart = F.log(F.col("n").cast("double") * F.lit(float(total)) / (F.col("n_head").cast("double") * F.col("n_tail").cast("double")))
    cohesion = cuts.groupBy("gram").agg(F.round(F.min(apart), DIGITS).alias("cohesion"))
    longer = counts.filter(size >= 3).withColumn("s", F.col("n") * F.log(F.col("n").cast("double")))
    after = longer.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("gram")).agg(F.sum("s").alias("after"))
    before = longer.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("s").alias("before"))

    def entropy(s: str) -> Column:
        return F.log(F.col("n").cast("double")) - F.coalesce(F.col(s), F.lit(0.0)) / F.col("n")

    both = grams.join(cohesion, "gram").join(after, "gram", "left").join(before, "gram", "left")
    return both.select("gram", "n", "cohesion", F.round(F.least(entropy("before"), entropy("after")), DIGITS).alias("freedom"))


def words_of(judged: DataFrame, min_cohesion: float = MIN_COHESION, min_freedom: float = MIN_FREEDOM) -> DataFrame:
    return judged.filter((F.col("cohesion") >= min_cohesion) & (F.col("freedom") >= min_freedom))


@dataclass(frozen=True)
class Lexicon:
    """A segmenter: call it with a run. ``counts`` has words and single characters, ``total`` all characters."""

    counts: dict[str, int]
    total: int
    longest: int = LONGEST
    _weights: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        self._weights.update({w: math.log(n / self.total) for w, n in self.counts.items()})

    @property
    def version(self) -> str:
        """What an index records: another dictionary cuts other words."""
        return "lexicon:" + hashlib.sha256("\n".join(f"{w} {n}" for w, n in sorted(self.counts.items())).encode()).hexdigest()[:16]

    def weight(self, word: str) -> float | None:
        """Logarithm of the word's frequency; an unknown character is rarer than any known one, an unknown
        longer string no word."""
        found = self._weights.get(word)
        return math.log(0.5 / max(1, self.total)) if found is None and len(word) == 1 else found

    def cut(self, run: str) -> list[str]:
        """The path of greatest weight; of two that tie, the one whose first word, and so on, is longer."""
        n = len(run)
        best, length = [0.0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            top = -math.inf
            for k in range(1, min(self.longest, n - i) + 1):
                weight = self.weight(run[i : i + k])
                if weight is not None and weight + best[i + k] >= top - 1e-12:
                    top, length[i] = max(top, weight + best[i + k]), k
            best[i] = top
        out, i = [], 0
        while i < n:
            out.append(run[i : i + length[i]])
            i += length[i]
        return out

    def __call__(self, run: str) -> list[str]:
        """Search terms of a run: pairs of stretches without a word; words after the shorter ones in them."""
        out: list[str] = []
        loose = ""
        for word in [*self.cut(run), ""]:
            if len(word) == 1:
                loose += word
                continue
            out += [loose] if len(loose) == 1 else [loose[i : i + 2] for i in range(len(loose) - 1)]
            loose = ""
            out += [word[i : i + k] for k in range(2, len(word)) for i in range(len(word) - k + 1) if word[i : i + k] in self.counts]
            out += [word] if word else []
        return out


def build(texts: DataFrame, text: str = "retrieval_text", longest: int = LONGEST, min_count: int = MIN_COUNT, min_cohesion: float = MIN_COHESION, min_freedom: float = MIN_FREEDOM, max_words: int = MAX_WORDS, more: Iterable[tuple[str, int]] = ()) -> DataFrame:
    """(word, n) of the texts' dictionary: its ``max_words`` most frequent words, all single characters, and the
    words of ``more`` with their counts (a dictionary of the user's own), which come first."""
    counts = written(string_counts(texts, text, longest), "strings")
    own = dict(more)
    words = words_of(judged_strings(counts, longest, min_count), min_cohesion, min_freedom).select(F.col("gram").alias("word"), "n").orderBy(F.desc("n"), "word").limit(max_words)
    single = counts.filter(F.length("gram") == 1).select(F.col("gram").alias("word"), "n")
    both = words.unionByName(single)
    if not own:
        return both
    given = texts.sparkSession.createDataFrame([*own.items()], "word string, n long")
    return both.join(F.broadcast(given.select("word")), "word", "left_anti").unionByName(given)  # as small as its list


def load(spark: SparkSession, path: str) -> Lexicon:
    return lexicon_of(spark.read.parquet(path))


def lexicon_of(words: DataFrame) -> Lexicon:
    """The dictionary in memory: MAX_WORDS words and the characters of a script."""
    counts = {r["word"]: r["n"] for r in words.collect()}
    return Lexicon(counts, max(1, sum(n for w, n in counts.items() if len(w) == 1)), max([LONGEST, *map(len, counts)]))
