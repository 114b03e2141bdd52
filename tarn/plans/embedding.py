"""Embedding providers. The hashed one needs no model; it is a stand-in for tests and offline use.

A service is asked once for each distinct text of a batch, in requests of like-sized texts, several at a time;
a request that fails for a passing reason is made again after a pause.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import terms
from tarn.shared import written

#: Texts to as many vectors.
Embedder = Callable[[list[str]], list[list[float]]]


def hashed_terms(text: Column, dimensions: int) -> Column:
    """Unit vector of a text's term counts, hashed to places with signs: equal for equal texts, near for
    texts that share terms. Not a model. A text without terms gives zeros."""
    places = F.transform(terms(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    totals = F.aggregate(places, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["at"]), F.create_map(p["at"], F.coalesce(F.try_element_at(m, p["at"]), F.lit(0.0)) + p["sign"])))
    length = F.sqrt(F.aggregate(F.map_values(totals), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at(totals, i), length), F.lit(0.0)).cast("float"))


def checked(vectors: list, count: int, dimensions: int) -> list:
    """The vectors, if they are as many as asked for, of the right size, and finite."""
    if len(vectors) != count:
        raise ValueError(f"{len(vectors)} vectors for {count} texts")
    for v in vectors:
        if len(v) != dimensions or not all(isinstance(x, (int, float)) and x == x and abs(x) != float("inf") for x in v):
            raise ValueError(f"a vector has not {dimensions} finite numbers")
    return vectors


def by_index(payload: dict, count: int, value: str, items: str) -> list:
    """Values of a service's answer in the order of the texts: each item names its text by ``index``."""
    rows = payload.get(items)
    if not isinstance(rows, list) or len(rows) != count:
        raise ValueError(f"the answer must hold {count} items")
    found = {}
    for row in rows:
        at = row.get("index") if isinstance(row, dict) else None
        if isinstance(at, bool) or not isinstance(at, int) or not 0 <= at < count or at in found:
            raise ValueError("an item's index is missing, out of range, or stands there twice")
        found[at] = row.get(value)
    return [found[i] for i in range(count)]


#: Answers after which a request may be made again: too many, or the server's own trouble.
PASSING = (429, 500, 502, 503, 504)
#: Requests for one answer, and the first pause in seconds, which doubles.
ATTEMPTS, PAUSE = 5, 0.5


def post_json(url: str, payload: dict, key: str | None = None, timeout: float = 60, attempts: int = ATTEMPTS, pause: float = PAUSE) -> dict:
    """The service's answer. A refused connection, a time-out or a PASSING status is tried again, ``attempts``
    times in all; the pauses double and vary, so that many tasks do not come back at once."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(payload).encode(), headers), timeout=timeout) as answer:  # noqa: S310
                return json.load(answer)
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            if attempt == attempts or isinstance(error, urllib.error.HTTPError) and error.code not in PASSING:
                raise
            time.sleep(pause * 2 ** (attempt - 1) * random.uniform(0.5, 1.5))
    raise AssertionError("attempts must be positive")


def packed(texts: list[str], most: int, characters: int) -> list[list[int]]:
    """Places of the texts in requests of ``most`` texts and about so many characters: like-sized ones together, the
    longest first, a text that is too long alone."""
    out: list[list[int]] = []
    left = 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if not out or len(out[-1]) == most or len(texts[i]) > left:
            out.append([])
            left = characters
        out[-1].append(i)
        left -= len(texts[i])
    return out


def http_embedder(url: str, model: str, batch_size: int = 32, key: str | None = None, timeout: float = 60, characters: int = 64_000, at_once: int = 4, attempts: int = ATTEMPTS, pause: float = PAUSE) -> Embedder:
    """An embedding service; a task has ``at_once`` requests under way at most."""

    def embed(texts: list[str]) -> list[list[float]]:
        def asked(places: list[int]) -> list:
            made = post_json(url, {"model": model, "input": [texts[i] for i in places]}, key, timeout, attempts, pause)
            return by_index(made, len(places), "embedding", "data")

        out: list = [None] * len(texts)
        requests = packed(texts, batch_size, characters)
        with ThreadPoolExecutor(at_once) as pool:
            for places, vectors in zip(requests, pool.map(asked, requests)):
                for i, vector in zip(places, vectors):
                    out[i] = vector
        return out

    return embed


def http_scorer(url: str, model: str, key: str | None = None, timeout: float = 60):
    """A rerank service, called once for each query of a batch."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out = [0.0] * len(texts)
        for query in dict.fromkeys(queries):
            at = [i for i, q in enumerate(queries) if q == query]
            got = by_index(post_json(url, {"model": model, "query": query, "documents": [texts[i] for i in at]}, key, timeout), len(at), "relevance_score", "results")
            for i, s in zip(at, got):
                out[i] = float(s)
        return out

    return score


def embed(rows: DataFrame, text: str, dimensions: int, embedder: Embedder | None = None, into: str = "embedding") -> DataFrame:
    """``rows`` with a vector of each text (null: empty); without an embedder, the hashed terms.

    An embedder is asked for each distinct text once: texts are told apart by their SHA-256, their vectors are
    written, and joined back. ``rows`` are written too, so that they are not made twice."""
    if embedder is None:
        return rows.withColumn(into, hashed_terms(F.col(text), dimensions))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = checked(embedder(batch["text"].tolist()), len(batch), dimensions)
                yield pd.DataFrame({"text_key": batch["text_key"], into: pd.Series(vectors, dtype=object)})

    known = F.coalesce(F.col(text), F.lit(""))
    keyed = written(rows.withColumn("text_key", F.sha2(F.encode(known, "UTF-8"), 256)), "keyed")
    texts = keyed.select("text_key", known.alias("text")).groupBy("text_key").agg(F.min("text").alias("text"))
    vectors = written(texts.mapInPandas(work, f"text_key string, `{into}` array<float>"), "vectors")
    # rows of a text that many share are split at run time where the vectors are no broadcast
    return keyed.join(vectors, "text_key").drop("text_key")
