"""URL filter: host rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these as a whole word of the URL rejects it.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "camgirls", "escorts", "nsfw", "warez", "keygen",
    "torrentz", "viagra", "cialis", "casino", "casinos", "spam", "malware", "phishing",
)
#: So many different ones of these reject it.
SOFT = (
    "adult", "sex", "sexy", "nude", "naked", "dating", "webcam", "bet", "bets", "betting", "poker", "slots",
    "gambling", "jackpot", "pills", "pharmacy", "cheap", "discount", "free", "crack", "cracked", "hack",
    "torrent", "download", "farm", "seo", "backlinks", "loan", "loans", "payday", "replica", "win", "prize",
)
SOFT_LIMIT = 2

#: (rule, verdict): host, then "/" and the start of the path.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def term_counts(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """Struct of ``strict_hits`` and ``soft_hits``: different terms that stand in the URL as whole words,
    that is with no ASCII letter or digit on either side; A-Z count as a-z. Null counts as empty."""
    kinds = {t.lower(): False for t in soft} | {t.lower(): True for t in strict}

    @F.pandas_udf("strict_hits int, soft_hits int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, is_strict in kinds.items():
            automaton.add_word(term, (term, is_strict))
        if kinds:
            automaton.make_automaton()
        edge = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        lower = {c: c + 32 for c in range(65, 91)}
        for urls in batches:
            strict_hits, soft_hits = [], []
            for url in urls:
                found = {False: set(), True: set()}
                if url and kinds:
                    url = url.translate(lower)
                    for last, (term, is_strict) in automaton.iter(url):
                        first = last - len(term)
                        if (first < 0 or url[first] not in edge) and (last + 1 == len(url) or url[last + 1] not in edge):
                            found[is_strict].add(term)
                strict_hits.append(len(found[True]))
                soft_hits.append(len(found[False]))
            yield pd.DataFrame({"strict_hits": pd.Series(strict_hits, dtype="int32"), "soft_hits": pd.Series(soft_hits, dtype="int32")})

    return count(url)


def judge_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``pages`` with one more column, the struct ``url_verdict``: host, path, rule, strict_hits,
    soft_hits and verdict. The verdict is that of the longest rule that fits, else ``block`` for one
    strict or ``soft_limit`` different soft terms, else ``allow``. It works row by row, without a
    shuffle; a null or empty URL has empty host and path, no terms, and is allowed. A column named
    url_verdict in the input is replaced; all others stay.
    """
    counts, host, path = term_counts(F.col(url), strict, soft), host_of(F.col(url)), path_of(F.col(url))
    rule, ruled = rule_of(host, path, rules)
    rows = pages.withColumn("url_verdict", counts)
    hits = F.col("url_verdict")
    own = F.when((hits.strict_hits > 0) | (hits.soft_hits >= soft_limit), "block").otherwise("allow")
    return rows.withColumn("url_verdict", F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), hits.strict_hits.alias("strict_hits"), hits.soft_hits.alias("soft_hits"), F.coalesce(ruled, own).alias("verdict")))
