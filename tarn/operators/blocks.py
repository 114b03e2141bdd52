"""BM25 top-k with pruning: postings in shards of chunks, in blocks with upper bounds.

A shard holds the chunks of one value of a hash, SHARD_CHUNKS at most on average. Its postings are a row for
each term: sorted chunk ids, frequencies and lengths as arrays, and for each BLOCK of them the greatest
frequency and the least length, from which a bound of the score follows whatever the average length is.
So a row is bounded whatever the corpus and however common the term, and a shard answers a query by itself:
its k best are all that is shuffled. A published index is bucketed by shard, so a search reads its terms'
rows without any shuffle before that.

A task takes a query's terms from the greatest bound to the least, adds them to one score for each chunk of the
shard, and looks at the k-th best score before common terms. Once the bounds of the terms to come cannot lift a new
chunk to it, only chunks at hand are looked up where these are few beside the term's postings; those
whose score, plus the bound of their block, plus the bounds to come, stays below it are dropped unread. What
is left out can never be among the k best, ties included, so the result is that of scoring everything.

Of a query of many terms, such as a whole document, hardly anything can be left out. Such queries are scored whole, some
at a time: common terms by one product of matrices, the others by one sum over all their postings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import Segmenter
from tarn.operators.bm25 import DIGITS, query_terms, tokenized
from tarn.shared import shared_path, written

SHARD_CHUNKS = 16_384
#: Fewest shards, so that a small corpus has work for some tasks.
SHARDS = 8
BUCKETS = 256
BLOCK = 128
#: So few chunks at hand are always looked up instead of adding a term to all of its chunks.
FEW = 256
#: Terms from which on a query is scored whole, and such queries at a time.
LONG, TOGETHER = 64, 32
#: A term is common that this share of a shard's chunks hold; numbers of a shard's matrix of such terms (8 bytes each).
COMMON, COMMON_NUMBERS = 0.1, 1 << 23
#: Rows (query, term) that one search sends to tasks, 12 bytes each; more queries go block by block, each of which reads the index.
ASKED_ROWS = 2_000_000
#: Terms up to which a filter names them, so that it reaches the scan.
NAMED_TERMS = 200
ROWS = "shard int, term string, ids array<bigint>, tfs array<int>, dls array<int>, top_tf array<int>, least_dl array<int>"


@dataclass(frozen=True)
class Blocks:
    rows: DataFrame
    term_stats: DataFrame  # term, df
    corpus_stats: DataFrame  # n, avgdl (one row)
    block: int = BLOCK

    def parts(self) -> list[tuple[DataFrame, DataFrame | None]]:
        """(posting rows, chunks of them that no longer count: shard and chunk_id) of each part of the index."""
        return [(self.rows, None)]


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _bounds(tfs: np.ndarray, dls: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest frequency and least length of each block, and where each term's blocks begin; a term's postings are starts[i]:starts[i+1]."""
    of = np.repeat(np.arange(len(starts) - 1), -(-np.diff(starts) // block))  # the term of each block
    first = np.searchsorted(of, np.arange(len(starts)))
    at = starts[of] + block * (np.arange(len(of)) - first[of])
    return *(f.reduceat(x, at) if len(at) else x for f, x in ((np.maximum, tfs), (np.minimum, dls))), first


def _shard_rows(key: tuple[pa.Scalar, ...], table: pa.Table, block: int) -> pa.Table:
    """Rows of one shard from its chunks (shard, chunk_id, dl, counts)."""
    table = table.combine_chunks()
    counts = table["counts"].chunk(0) if len(table) else pa.array([], table.schema.field("counts").type)
    n = counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = counts.flatten()
    terms = flat.field("term").dictionary_encode()
    names, code = terms.dictionary, terms.indices.to_numpy()
    ids, dls = (np.repeat(table[c].to_numpy(), n) for c in ("chunk_id", "dl"))
    order = np.lexsort((ids, code))
    code, ids, dls, tfs = code[order], ids[order], dls[order].astype(np.int32), flat.field("tf").to_numpy()[order].astype(np.int32)
    starts = np.searchsorted(code, np.arange(len(names) + 1))
    top, least, first = _bounds(tfs, dls, starts, block)
    columns = [pa.array(np.full(len(names), key[0].as_py()), pa.int32()), names.cast(pa.string()), _lists(ids, starts, pa.int64()), _lists(tfs, starts, pa.int32()), _lists(dls, starts, pa.int32()), _lists(top, first, pa.int32()), _lists(least, first, pa.int32())]
    return pa.Table.from_arrays(columns, ["shard", "term", "ids", "tfs", "dls", "top_tf", "least_dl"])


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")


def posting_rows(tokens: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(posting rows, number of shards) of tokenized chunks (chunk_id, dl, counts)."""
    shards = max(SHARDS, -(-tokens.count() // SHARD_CHUNKS))
    dealt = tokens.withColumn("shard", shard_of(shards))
    return dealt.groupBy("shard").applyInArrow(lambda key, table: _shard_rows(key, table, block), ROWS), shards


def _built(chunks: DataFrame, text: str, segmenter: Segmenter | None, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """(posting rows, corpus statistics, number of shards); every chunk counts, also one without terms."""
    tokens = tokenized(chunks, text, segmenter)
    corpus = tokens.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    rows, shards = posting_rows(tokens, block)
    return rows, corpus, shards


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum(F.size("ids")).cast("long").alias("df"))


def build(chunks: DataFrame, text: str = "retrieval_text", segmenter: Segmenter | None = None, block: int = BLOCK) -> Blocks:
    """An index of the chunks (chunk_id, text) for this session. Chunk ids are unique."""
    rows, corpus, _ = _built(chunks, text, segmenter, block)
    rows = written(rows, "blocks")
    return Blocks(rows, _stats(rows), written(corpus, "corpus"), block)


def _name(path: str) -> str:
    return f"tarn_{hashlib.sha256(path.encode()).hexdigest()[:32]}"


def save_rows(rows: DataFrame, shards: int, path: str) -> int:
    """Write posting rows in buckets under ``path``; the number of buckets."""
    buckets = min(BUCKETS, shards)
    rows.repartition(buckets, "shard").write.bucketBy(buckets, "shard").sortBy("shard", "term").option("path", f"{path}/blocks").option("compression", "zstd").saveAsTable(_name(path))
    return buckets


def load_rows(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Posting rows under ``path``; a session that did not write them gets to know their buckets."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({ROWS}) USING parquet CLUSTERED BY (shard) SORTED BY (shard, term) INTO {buckets} BUCKETS LOCATION '{path}/blocks'")
    return spark.table(_name(path))


def save(chunks: DataFrame, path: str, text: str = "retrieval_text", segmenter: Segmenter | None = None) -> int:
    """Write an index under ``path``, bucketed by shard; the number of its buckets."""
    rows, corpus, shards = _built(chunks, text, segmenter)
    buckets = save_rows(rows, shards, path)
    _stats(chunks.sparkSession.read.schema(ROWS).parquet(f"{path}/blocks")).write.parquet(f"{path}/term_stats")
    corpus.write.parquet(f"{path}/corpus_stats")
    return buckets


def load(spark: SparkSession, path: str, buckets: int) -> Blocks:
    """The index that ``save`` wrote."""
    return Blocks(load_rows(spark, path, buckets), spark.read.parquet(f"{path}/term_stats"), spark.read.parquet(f"{path}/corpus_stats"))


class _Postings:
    """One term's postings in a shard, and the bounds of what a query's unit of it can add."""

    def __init__(self, ids: np.ndarray, tfs: np.ndarray, dls: np.ndarray, top_tf: np.ndarray, least_dl: np.ndarray, norm):
        self.ids, self.tfs, self.dls, self.norm = ids, tfs, dls, norm
        self.bounds = top_tf / (top_tf + norm(least_dl))
        self.bound = float(self.bounds.max())

    def adds(self, tfs: np.ndarray, dls: np.ndarray) -> np.ndarray:
        tf = tfs.astype(np.float64)
        return tf / (tf + self.norm(dls))

    def parts(self, at: np.ndarray | slice) -> np.ndarray:
        return self.adds(self.tfs[at], self.dls[at])


class _Shard:
    """Postings of a shard by the places of its chunks, with what a query's unit of a term adds, and a score for each chunk."""

    def __init__(self, postings: dict[str, _Postings]):
        self.postings, each = postings, list(postings.values())
        flat = [np.concatenate([getattr(p, c) for p in each]) if each else np.zeros(0, np.int64) for c in ("ids", "tfs", "dls")]
        self.chunks = np.unique(flat[0])
        self.scores = np.zeros(len(self.chunks))
        at, adds = np.searchsorted(self.chunks, flat[0]), each[0].adds(flat[1], flat[2]) if each else flat[0]
        ends = np.cumsum([len(p.ids) for p in each]).tolist()
        for p, start, end in zip(each, [0, *ends], ends):
            p.at, p.part = at[start:end], adds[start:end]


class _Part:
    """A term's postings within the arrays of a shard."""

    __slots__ = ("ids", "at", "part", "bounds", "bound")


class _Flat:
    """Postings of a shard in arrays, term after term, as a ``_Shard`` whose terms are their numbers."""

    def __init__(self, ids: np.ndarray, tfs: np.ndarray, dls: np.ndarray, starts: np.ndarray, top_tf: np.ndarray, least_dl: np.ndarray, first: np.ndarray, norm):
        self.ids, self.starts, self.first, self.postings = ids, starts, first, self
        self.chunks = np.unique(ids)
        self.scores = np.zeros(len(self.chunks))
        tfs = tfs.astype(np.float64)
        self.at, self.part, self.bounds = np.searchsorted(self.chunks, ids), tfs / (tfs + norm(dls)), top_tf / (top_tf + norm(least_dl))
        self.bound = np.maximum.reduceat(self.bounds, first[:-1]) if len(first) > 1 else self.bounds
        self.matrix, self.place = None, np.full(len(starts) - 1, -1)

    def get(self, term: int) -> _Part | None:
        if term < 0:
            return None
        own, mine = _Part(), slice(self.starts[term], self.starts[term + 1])
        own.ids, own.at, own.part, own.bounds, own.bound = self.ids[mine], self.at[mine], self.part[mine], self.bounds[self.first[term] : self.first[term + 1]], float(self.bound[term])
        return own

    def whole(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of all chunks for queries (terms, weights)."""
        n = len(self.chunks)
        if self.matrix is None:
            size = np.diff(self.starts)
            common = np.argsort(-size, kind="stable")[: COMMON_NUMBERS // max(1, n)]
            common = common[size[common] >= COMMON * n]
            self.place[common], self.matrix = np.arange(len(common)), np.zeros((len(common), n))
            for i, term in enumerate(common.tolist()):
                mine = slice(self.starts[term], self.starts[term + 1])
                self.matrix[i, self.at[mine]] = self.part[mine]
        weights, places = np.zeros((len(asked), len(self.matrix))), [self.place[terms] for terms, _ in asked]
        for row, place, (_, weight) in zip(weights, places, asked):
            row[place[place >= 0]] = weight[place >= 0]
        scores = weights @ self.matrix
        for row, place, (terms, weight) in zip(scores, places, asked):
            begin, end = (self.starts[terms[place < 0] + i] for i in (0, 1))
            size = end - begin
            which = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            row += np.bincount(self.at[which], self.part[which] * np.repeat(weight[place < 0], size), n)
        return scores


def _top(chunks: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(scores)
    least = float(np.partition(scores, n - k)[n - k]) if n > k else 0.0
    keep = np.flatnonzero((scores > 0) & (scores >= least - 1e-8))  # more than rounding takes away
    found = np.round(scores[keep], DIGITS)
    keep, found = keep[found > 0], found[found > 0]
    order = np.lexsort((keep, -found))[:k]  # places follow ids
    return chunks[keep[order]], found[order]


def best_of(asked: list[tuple[str | int, float]], postings: dict[str, _Postings] | _Shard | _Flat, k: int, block: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(ids, scores, postings, postings scored) of the k best chunks of a shard for a query's (term, weight)."""
    shard = _Shard(postings) if isinstance(postings, dict) else postings
    known = sorted(((w * own.bound, w, own) for t, w in asked if (own := shard.postings.get(t))), key=lambda x: -x[0])
    rest = [*np.cumsum([x[0] for x in known][::-1])[::-1], 0.0]  # bounds from each term on
    scores, n = shard.scores, len(shard.chunks)
    scores[:] = 0
    worst, scored, near, top, looked = -1.0, 0, None, None, 0
    for (_, weight, own), beyond, left in zip(known, rest, rest[1:]):
        size = len(own.ids)
        # rounding and the order of a sum move a score by less
        slack = 1e-9 + 1e-12 * beyond
        if near is None and 4 * size >= n > k and beyond < scores.max() - slack:  # a look at the k-th best costs as much as some postings
            if top is None or scored - looked >= 4 * n:
                top, looked = np.argpartition(scores, n - k)[n - k :], scored
            worst = max(worst, float(scores[top].min()))
            if beyond < worst - slack:
                near = np.arange(n)
        if near is not None:
            near = near[scores[near] + beyond >= worst - slack]
            if len(near) < size and (8 * len(near) < size or len(near) <= FEW):
                at = np.searchsorted(own.at, near)
                hopeful = scores[near] + weight * own.bounds[np.minimum(at, size - 1) // block] + left >= worst - slack
                near, at = near[hopeful], at[hopeful]
                there = at < size
                there[there] = own.at[at[there]] == near[there]
                scored += int(there.sum())
                scores[near[there]] += weight * own.part[at[there]]
                if len(near) >= k:
                    worst = max(worst, float(np.partition(scores[near], len(near) - k)[len(near) - k]))
                continue
        scored += size
        scores[own.at] += weight * own.part
    return *_top(shard.chunks, scores, k), sum(len(x[2].ids) for x in known), scored


def _searching(asked: tuple[list, np.ndarray, np.ndarray, np.ndarray], names: pa.Array, k: int, avgdl: float, k1: float, b: float, of: pa.DataType, block: int):
    """``asked``: queries, where the terms of each begin, and all terms (numbers in ``names``) and weights."""
    queries, begin, terms, weights = asked

    def norm(dl: np.ndarray) -> np.ndarray:
        return k1 * (1 - b + b * dl / avgdl)

    def shard_of_rows(table: pa.Table, gone: np.ndarray) -> tuple[pa.Array, _Flat]:
        """The terms of a shard and their postings, less those of chunks that are gone, in blocks of their own."""
        lists = {c: table[c].combine_chunks() if len(table) else pa.array([], table.schema.field(c).type) for c in ("term", "ids", "tfs", "dls", "top_tf", "least_dl")}
        lists = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in lists.items()}
        offsets = lambda c: lists[c].offsets.to_numpy().astype(np.int64) - (lists[c].offsets[0].as_py() if len(lists[c].offsets) else 0)
        ids, tfs, dls, top, least = (lists[c].flatten().to_numpy() for c in ("ids", "tfs", "dls", "top_tf", "least_dl"))
        starts, first, known = offsets("ids"), offsets("top_tf"), lists["term"]
        stays = ~np.isin(ids, gone) if len(gone) else np.ones(0, bool)
        if not stays.all():
            left = np.diff(np.concatenate([[0], np.cumsum(stays)])[starts])
            known, ids, tfs, dls = known.filter(pa.array(left > 0)), ids[stays], tfs[stays], dls[stays]
            starts = np.concatenate([[0], np.cumsum(left[left > 0])])
            top, least, first = _bounds(tfs, dls, starts, block)
        return known, _Flat(ids, tfs, dls, starts, top, least, first, norm)

    def work(key: tuple[pa.Scalar, ...], table: pa.Table, dead: pa.Table | None = None) -> pa.Table:
        known, shard = shard_of_rows(table, np.zeros(0, np.int64) if dead is None else dead["chunk_id"].to_numpy())
        own = pc.fill_null(pc.index_in(names, known), -1).to_numpy()[terms]  # the number in the shard of each asked term
        out: list[list] = [[], [], [], [], []]

        def add(query: int, ids: np.ndarray, scores: np.ndarray, n: int, scored: int) -> None:
            if n:  # the first row of a query also says what was done for it
                rows = max(1, len(ids))
                out[0].extend([queries[query]] * rows)
                out[1].extend(ids.tolist() or [None])
                out[2].extend(scores.tolist() or [None])
                out[3].extend([n] + [0] * (rows - 1))
                out[4].extend([scored] + [0] * (rows - 1))

        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            for (query, mine, _), scores in zip(held, shard.whole([x[1:] for x in held])):
                n = int((shard.starts[mine + 1] - shard.starts[mine]).sum())
                add(query, *_top(shard.chunks, scores, k), n, n)
            held.clear()

        for query in range(len(queries)):
            mine, weight = own[begin[query] : begin[query + 1]], weights[begin[query] : begin[query + 1]]
            mine, weight = mine[mine >= 0], weight[mine >= 0]
            if len(mine) < LONG:
                add(query, *best_of(list(zip(mine.tolist(), weight.tolist())), shard, k, block))
                continue
            held.append((query, mine, weight))
            if len(held) == TOGETHER:
                flush()
        if held:
            flush()
        kinds = (of, pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["query_id", "chunk_id", "score", "postings", "scored"])

    return work


def search(queries: DataFrame, index: Blocks, k: int, text: str = "query", k1: float = 1.5, b: float = 0.75, segmenter: Segmenter | None = None) -> DataFrame:
    """The k best of every shard and query: query_id, chunk_id, score, and the numbers of postings that the
    query's terms have and that were scored (in one row a shard and query, 0 in others). Written once."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    asked = written(query_terms(queries, text, segmenter), "asked")
    known = index.term_stats.join(asked.select("term").distinct(), "term", "left_semi")
    corpus = index.corpus_stats.first()
    idf = F.log(1 + (F.lit(corpus["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = written(asked.join(known, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")), "weighed")
    blocks = -(-weighed.count() // ASKED_ROWS)
    kind = queries.schema["query_id"].dataType
    of = pa.string() if kind.simpleString() == "string" else pa.int32() if kind.simpleString() == "int" else pa.int64()
    schema = f"query_id {kind.simpleString()}, chunk_id long, score double, postings long, scored long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        one = weighed if blocks == 1 else weighed.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = one.toArrow().combine_chunks()
        if not len(rows):
            continue
        coded, names = (rows[c].chunk(0).dictionary_encode() for c in ("query_id", "term"))
        terms, number = names.dictionary.cast(pa.string()), coded.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        asked_of = coded.dictionary.to_pylist(), np.searchsorted(number[order], np.arange(len(coded.dictionary) + 1)), names.indices.to_numpy()[order], rows["weight"].to_numpy()[order]
        work, part = _searching(asked_of, terms, k, corpus["avgdl"], k1, b, of, index.block), None
        for rows, dead in index.parts():
            if len(terms) <= NAMED_TERMS:
                rows = rows.filter(F.col("term").isin(terms.to_pylist()))
            else:  # at most ASKED_ROWS terms
                rows = rows.join(F.broadcast(one.select("term").distinct()), "term", "left_semi")
            groups = rows.groupBy("shard")
            own = groups.applyInArrow(lambda key, table: work(key, table), schema) if dead is None else groups.cogroup(dead.groupBy("shard")).applyInArrow(lambda key, left, right: work(key, left, right), schema)
            part = own if part is None else part.unionByName(own)
        found = written(part, "found") if blocks == 1 else found.unionByName(written(part, "found"))
    return found


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score of the k best chunks of a search; ties by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.filter("chunk_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def work_done(found: DataFrame) -> DataFrame:
    """query_id, postings (of the query's terms), scored and skipped (the share that no score was made of)."""
    done = found.groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored"))
    return done.withColumn("skipped", 1 - F.col("scored") / F.col("postings"))


def bm25_topk(queries: DataFrame, index: Blocks, k: int, text: str = "query", k1: float = 1.5, b: float = 0.75, segmenter: Segmenter | None = None) -> DataFrame:
    """The same rows as ``bm25.bm25_topk``."""
    return ranked(search(queries, index, k, text, k1, b, segmenter), k)
