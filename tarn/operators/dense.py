"""Dense retrieval: exact and approximate cosine top-k for batches of queries.

Queries go to every task in blocks of bounded size, of which the driver holds one at a time. Each task
multiplies its vectors with a block, TILE products at a time, and keeps its own k best, so what is shuffled is k rows a task and
query, whatever the number of vectors. The approximate search does so for pairs of a query and a list
that it probes only, from a table that is laid out by list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.vector import is_finite
from tarn.shared import shared_path, written

#: Numbers in a block of query vectors (8 bytes each).
BLOCK_NUMBERS = 1 << 20
#: Products of queries and vectors that a task holds at a time (8 bytes each).
TILE = 1 << 20
#: Digits of a distance: equal vectors must tie, wherever they stand in a batch.
DIGITS = 12


def in_space(chunks: DataFrame, model: str | None = None, dimensions: int | None = None) -> DataFrame:
    """The chunks of one vector space; both conditions reach the scan."""
    if model is not None:
        chunks = chunks.filter(F.col("embedding_model") == model)
    return chunks if dimensions is None else chunks.filter(F.col("embedding_dimensions") == dimensions)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dimensions:
        raise ValueError(f"a vector has not {dimensions} numbers")
    return flat.reshape(len(column), dimensions)


def query_blocks(queries: DataFrame, dimensions: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, unit vectors) of the queries (query_id, embedding) in blocks of about BLOCK_NUMBERS numbers,
    dealt by hash of the id. A query without length, of other dimensions or with numbers that are not
    finite raises ValueError."""
    asked = queries.select("query_id", "embedding")
    step = max(1, BLOCK_NUMBERS // dimensions)
    blocks = 1 if len(head := asked.limit(step + 1).collect()) <= step else asked.count() // step + 1
    dealt = asked if blocks == 1 else written(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "asked")
    for b in range(blocks):
        rows = head if blocks == 1 else dealt.filter(F.col("block") == b).collect()
        if not rows:
            continue
        ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
        length = np.linalg.norm(vectors, axis=1) if vectors.ndim == 2 and vectors.shape[1] == dimensions else None
        if length is None or not np.isfinite(vectors).all() or np.isclose(length, 0).any():
            raise ValueError(f"query vectors must have {dimensions} finite numbers and a length")
        yield ids, vectors / length[:, None]


class Nearest:
    """Each query's k best chunks so far: by least distance, then least id. Holds k rows a query; what is sorted
    at a time are the rows of one call that are not beyond the k-th of before."""

    def __init__(self, queries: int, k: int):
        self.chunk, self.distance, self.more = np.zeros((queries, k), np.int64), np.full((queries, k), np.nan), np.zeros((queries, k), np.int32)

    def add(self, asking: np.ndarray, chunk: np.ndarray, distance: np.ndarray, more: np.ndarray | None = None) -> None:
        """``distance`` has a row for each of ``asking`` and a column for each chunk, NaN where it is none; ``more`` is a number of each chunk."""
        k, n = self.distance.shape[1], len(asking)
        limit = np.where(np.isnan(self.distance[asking, -1]), np.inf, self.distance[asking, -1])
        if distance.shape[1] > k and np.isinf(limit).any():
            limit = np.fmin(limit, np.partition(distance, k - 1, axis=1)[:, k - 1])
        row, column = np.nonzero(distance <= limit[:, None])
        if not len(row):
            return
        of = np.concatenate([np.repeat(np.arange(n), k), row])
        held = [np.concatenate([x[asking].ravel(), new]) for x, new in ((self.chunk, chunk[column]), (self.distance, distance[row, column]), (self.more, more[column] if more is not None else np.zeros(len(row), np.int32)))]
        order = np.lexsort((held[0], held[1], of))
        of = of[order]
        best = order[np.arange(len(of)) - np.searchsorted(of, of) < k].reshape(n, k)
        self.chunk[asking], self.distance[asking], self.more[asking] = (x[best] for x in held)


def tiles(asking: np.ndarray, chunks: int) -> Iterator[np.ndarray]:
    """The queries in runs whose products with so many chunks are TILE numbers at most."""
    step = max(1, TILE // max(1, chunks))
    return (asking[i : i + step] for i in range(0, len(asking), step))


def _best(block: tuple[list, np.ndarray], k: int, probes: np.ndarray | None):
    """Batches (chunk_id, embedding, list) to each query's k nearest chunks of the task."""
    ids, vectors = block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Nearest(len(ids), k)
        for batch in batches:
            if not len(batch):
                continue
            every = batch.column(0).to_numpy(), _matrix(batch.column(1), vectors.shape[1])
            lists = batch.column(2).to_numpy() if probes is not None else np.zeros(len(batch), np.int32)
            for own in np.unique(lists):
                chunk, matrix = (x[lists == own] for x in every)
                length = np.linalg.norm(matrix, axis=1)
                for asking in tiles(np.flatnonzero(probes[:, own]) if probes is not None else np.arange(len(ids)), len(chunk)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        similarity = (vectors[asking] @ matrix.T) / length
                    kept.add(asking, chunk, np.where(length > 0, np.round(1 - similarity, DIGITS), np.inf))  # without length: last
        row, column = np.nonzero(~np.isnan(kept.distance))
        yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row]), pa.array(kept.chunk[row, column]), pa.array(kept.distance[row, column])], ["query_id", "chunk_id", "distance"])

    return work


def _search(queries: DataFrame, chunks: DataFrame, k: int, dimensions: int, probes=None) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    of = queries.schema["query_id"].dataType.simpleString()
    found = before = None
    for block in query_blocks(queries, dimensions):
        if before is not None:  # more than one block: each is searched before the next one is collected
            before = written(before, "nearest")
            found = before if found is None else found.unionByName(before)
        mask = probes(block[1]) if probes else None
        rows = chunks if mask is None else chunks.filter(F.col("list").isin(np.flatnonzero(mask.any(axis=0)).tolist()))
        before = rows.mapInArrow(_best(block, k, mask), f"query_id {of}, chunk_id long, distance double")
    if before is not None:
        found = before if found is None else found.unionByName(before)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], f"query_id {of}, chunk_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    distance = F.when(F.col("distance") != float("inf"), F.col("distance"))
    return ranked.select("query_id", "rank", "chunk_id", distance.alias("cosine_distance"), (1 - distance).alias("cosine_similarity"))


def exact_topk(queries: DataFrame, chunks: DataFrame, k: int, dimensions: int, model: str | None = None) -> DataFrame:
    """The k nearest chunks of each query by cosine distance over all vectors of the space: query_id,
    rank (from 1), chunk_id, cosine_distance, cosine_similarity. Ties go by chunk_id; chunks without
    length come last, with null distance."""
    space = in_space(chunks, model, dimensions if model is not None else None)
    return _search(queries, space.select("chunk_id", "embedding"), k, dimensions)


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The ranked rows with their chunk's and document's columns; chunks that are gone drop out, and
    ranks close up. The ranking is cut before the join, so few rows take part in it."""
    rows = ranked.join(chunks.drop("embedding"), "chunk_id").join(documents.withColumnRenamed("id", "document_id").drop("content_hash", "created_at"), "document_id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


@dataclass(frozen=True)
class Lists:
    """An inverted-list index: each chunk by its nearest centre."""

    centers: np.ndarray
    chunks: DataFrame  # chunk_id, embedding, list

    def probes(self, nprobe: int):
        return lambda vectors: _nearest_mask(vectors, self.centers, nprobe)


def _nearest_mask(vectors: np.ndarray, centers: np.ndarray, nprobe: int) -> np.ndarray:
    mask = np.zeros((len(vectors), len(centers)), bool)
    for asking in tiles(np.arange(len(vectors)), len(centers)):
        mask[asking[:, None], np.argsort(-(vectors[asking] @ centers.T), axis=1, kind="stable")[:, :nprobe]] = True
    return mask


def _centers(sample: np.ndarray, lists: int, seed: int, turns: int) -> np.ndarray:
    """Spherical k-means on the sample."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(turns):
        own = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
    return centers


def lists_for(rows: int) -> int:
    """Lists of an index over so many rows: the square root, so that lists and rows of a list grow alike."""
    return min(4096, max(16, round(rows**0.5)))


def build_lists(chunks: DataFrame, dimensions: int, lists: int | None = None, sample_rows: int = 20_000, seed: int = 7, turns: int = 10, path: str | None = None) -> Lists:
    """Index every chunk, in ``lists`` lists (by default as many as fit the number of rows). Centres are
    fitted on ``sample_rows`` chunks at most, those of least hash of the id. The table is written in a
    folder for each list, so that a search reads the lists it probes; with a ``path``, it can be loaded
    again from there."""
    spark = chunks.sparkSession
    usable = chunks.filter(is_finite(F.col("embedding"), dimensions)).select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    lists = lists_for(usable.count()) if lists is None else lists
    sample = usable.orderBy(F.xxhash64("chunk_id", F.lit(seed))).limit(sample_rows).select("embedding").collect()
    centers = _centers(np.array([r[0] for r in sample], np.float64), lists, seed, turns) if sample else np.zeros((1, dimensions))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.argmax(_matrix(batch.column(1), dimensions) @ centers.T, axis=1) if len(batch) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["chunk_id", "embedding", "list"])

    path = path or shared_path(spark, "lists")
    indexed = usable.mapInArrow(assign, f"chunk_id long, embedding {usable.schema['embedding'].dataType.simpleString()}, list int")
    indexed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    return load_lists(spark, path)


def load_lists(spark: SparkSession, path: str) -> Lists:
    centers = [r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()]  # 4096 at most
    rows = spark.read.schema("chunk_id long, embedding array<float>, list int").parquet(f"{path}/rows")
    return Lists(np.array(centers), rows)


def ann_topk(queries: DataFrame, index: Lists, k: int, dimensions: int, nprobe: int | None = None) -> DataFrame:
    """Like ``exact_topk`` with exact distances, but only over the ``nprobe`` lists nearest to each query
    (by default five eighths of all, which data without clusters needs for a recall of 0.9)."""
    nprobe = -(-5 * len(index.centers) // 8) if nprobe is None else nprobe
    return _search(queries, index.chunks.select("chunk_id", "embedding", "list"), k, dimensions, index.probes(nprobe))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact results that were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("expected"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count("*")).alias("recall"))


def plan_text(frame: DataFrame) -> str:
    """The formatted physical plan, as ``explain`` prints it."""
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
