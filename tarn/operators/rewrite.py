"""Query rewriting by fixed rules, and the difference between two rankings."""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The dictionary of short names that ships with the engine.
ALIASES = {
    "PG": "PostgreSQL",
    "WAL": "Write-Ahead Log",
    "RAG": "Retrieval-Augmented Generation",
    "REST": "Representational State Transfer",
    "API": "Application Programming Interface",
    "依赖注入": "Dependency Injection",
    "请求体": "Request Body",
    "路径参数": "Path Parameters",
    "查询参数": "Query Parameters",
    "鉴权": "Authentication",
    "向量检索": "Vector Search",
    "混合检索": "Hybrid Search",
}


class BadAliases(ValueError):
    """The alias dictionary cannot be used."""


def load_aliases(text: str) -> dict[str, str]:
    """Aliases of a dictionary ``{"version": 1, "aliases": {...}}``."""
    try:
        got = json.loads(text)
    except ValueError as error:
        raise BadAliases("the alias dictionary is not JSON") from error
    if not isinstance(got, dict) or got.get("version") is True or got.get("version") != 1 or not isinstance(got.get("aliases"), dict):
        raise BadAliases("the alias dictionary must have version 1 and a mapping of aliases")
    return check_aliases(got["aliases"])


def check_aliases(aliases: Mapping[str, str]) -> dict[str, str]:
    """Trimmed aliases with their names. Blank ones, two that differ in case only, and none are errors."""
    pairs = list(aliases.items())
    if not pairs or not all(isinstance(x, str) and x.strip() for pair in pairs for x in pair):
        raise BadAliases("a dictionary needs aliases, each with a name, and none of them blank")
    trimmed = {alias.strip(): name.strip() for alias, name in pairs}
    folded = Counter(alias.strip().casefold() for alias, _ in pairs)
    if twice := [x for x, n in folded.items() if n > 1]:
        raise BadAliases(f"aliases that differ in case only: {', '.join(twice)}")
    return trimmed


def _folded(text: str) -> str:
    """Case folded character by character, so that places stay."""
    whole = text.casefold()
    return whole if len(whole) == len(text) else "".join(f if len(f := c.casefold()) == 1 else c for c in text)


def _bound(character: str) -> bool:
    return character.isascii() and character.isalnum()


class Rewriter:
    """The rules in turn: NFKC, white space, aliases.

    Aliases are found in one pass by an automaton, in any case, so a dictionary may hold any number of them.
    Letters and digits of ASCII must not go on before one that begins with such a character, nor after one that
    ends with it; where several fit at a place, one with such an end comes first, then the longer one."""

    def __init__(self, aliases: Mapping[str, str]):
        self.finder = ahocorasick.Automaton()
        for alias, name in aliases.items():
            self.finder.add_word(_folded(alias), (alias, name))
        self.finder.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(begin, end, alias, name) of the aliases from left to right, none inside or across another."""
        at_place: dict[int, tuple] = {}
        for last, (alias, name) in self.finder.iter(_folded(text)):
            begin, end = last + 1 - len(alias), last + 1
            if _bound(alias[0]) and begin and _bound(text[begin - 1]) or _bound(alias[-1]) and end < len(text) and _bound(text[end]):
                continue
            rank = (_bound(alias[-1]), len(alias))
            if begin not in at_place or rank > at_place[begin][0]:
                at_place[begin] = rank, end, alias, name
        until = 0
        for begin in sorted(at_place):
            if begin >= until:
                _, until, alias, name = at_place[begin]
                yield begin, until, alias, name

    def spots(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(begin, end, alias, what it becomes) of all aliases that are to be expanded."""
        for begin, end, alias, name in self.found(text):
            written_out = f"{name} ({text[begin:end]})"
            around = text[max(0, begin - len(name) - 2) : end + 1]
            if written_out.casefold() not in (around.casefold(), f"{name} ({name})".casefold()):
                yield begin, end, alias, written_out

    def __call__(self, query: str) -> tuple[str, str, list[str]]:
        """(normalized query, effective query, applied rules). A blank query raises ValueError."""
        composed = unicodedata.normalize("NFKC", query)
        flat = " ".join(composed.split())
        if flat == "":
            raise ValueError("there is nothing to search for in a blank query")
        spots = list(self.spots(flat))
        edges = [0, *(x for begin, end, *_ in spots for x in (begin, end)), len(flat)]
        between = [flat[a:b] for a, b in zip(edges[::2], edges[1::2])]
        effective = between[0] + "".join(new + rest for (*_, new), rest in zip(spots, between[1:]))
        rules = [name for name, changed in (("unicode_nfkc", composed != query), ("whitespace", flat != composed)) if changed]
        return flat, effective, rules + [f"alias:{a}" for a in dict.fromkeys(alias for _, _, alias, _ in spots)]


def rewrite_queries(queries: DataFrame, aliases: Mapping[str, str] | None = None, enabled: bool = True, query: str = "query") -> DataFrame:
    """``queries`` with normalized_query, effective_query and applied_rules. Switched off, both are the
    query itself and the dictionary is not looked at."""
    if not enabled:
        return queries.withColumns({"normalized_query": F.col(query), "effective_query": F.col(query), "applied_rules": F.array().cast("array<string>")})
    known = check_aliases(ALIASES if aliases is None else aliases)

    @F.pandas_udf("struct<normalized_query:string,effective_query:string,applied_rules:array<string>>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter(known)
        for texts in batches:
            yield pd.DataFrame([rewriter(t or "") for t in texts], columns=["normalized_query", "effective_query", "applied_rules"])

    return queries.withColumn("__r", work(F.col(query))).select(*queries.columns, "__r.*")


def ranking_diff(without: DataFrame, with_rewrite: DataFrame) -> DataFrame:
    """Both rankings (query_id, rank, chunk_id) side by side: query_id, position in the union (those of
    ``without`` in their order, then the new ones), chunk_id, rank_without, rank_with, rank_delta
    (positive: moved up; null if one side lacks the chunk)."""
    a = without.select("query_id", "chunk_id", F.col("rank").alias("rank_without"))
    b = with_rewrite.select("query_id", "chunk_id", F.col("rank").alias("rank_with"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rank_without"), "rank_with")
    return both.select("query_id", F.row_number().over(order).alias("position"), "chunk_id", "rank_without", "rank_with", (F.col("rank_without") - F.col("rank_with")).alias("rank_delta"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """For each query: n_overlap, n_only_without, n_only_with and same_order (both rankings are equal)."""
    return diff.groupBy("query_id").agg(
        F.count("rank_delta").alias("n_overlap"),
        F.count_if(F.col("rank_with").isNull()).alias("n_only_without"),
        F.count_if(F.col("rank_without").isNull()).alias("n_only_with"),
        F.coalesce(F.bool_and(F.col("rank_without").eqNullSafe(F.col("rank_with"))), F.lit(True)).alias("same_order"),
    )
