"""Approximate dense search over product-quantised residuals, with exact re-scoring of a short list.

Every vector belongs to the list of its nearest centre. What is left of it, cut into pairs of dimensions, is
coded by the nearest of CODES values of each pair: a byte for two numbers. A query's product with a vector is
its product with the centre plus one table entry a byte, so a search reads an eighth of what the vectors take,
keeps ``short`` candidates a task and query, and reads whole vectors only for the short list, from the
lists that hold it. Distances in the result are exact.

Codes and vectors are columns of one table that is laid out by list, so a scan reads those it needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.vector import is_finite
from tarn.operators import dense
from tarn.shared import shared_path, written

#: Dimensions that share a code, and codes for them.
PAIR, CODES = 2, 256
#: Candidates of the short list for each result, by default.
SHORT = 3
#: Rows of a list in one file.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Index:
    centers: np.ndarray  # list, dimension
    books: np.ndarray  # pair, code, dimension of the pair
    chunks: DataFrame  # chunk_id, code, embedding, list


def _cut(vectors: np.ndarray) -> np.ndarray:
    """(pair, row, dimension of the pair); an odd last dimension gets a zero beside it."""
    n, d = vectors.shape
    wide = np.zeros((n, -(-d // PAIR) * PAIR))
    wide[:, :d] = vectors
    return wide.reshape(n, wide.shape[1] // PAIR, PAIR).transpose(1, 0, 2)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1) - 2 * points @ book.T, axis=1)


def fit_books(residuals: np.ndarray, seed: int, turns: int = 8) -> np.ndarray:
    """Codes of each pair of dimensions: k-means on the sample's residuals."""
    rng, cut = np.random.default_rng(seed), _cut(residuals)
    books = np.zeros((len(cut), CODES, PAIR))
    for book, points in zip(books, cut):
        if not len(points):
            continue
        book[:] = points[rng.integers(0, len(points), CODES)]
        for _ in range(turns):
            own = _nearest(points, book)
            n = np.bincount(own, minlength=CODES)
            for axis in range(PAIR):
                sums = np.bincount(own, points[:, axis], minlength=CODES)
                book[n > 0, axis] = sums[n > 0] / n[n > 0]
    return books


def encoded(vectors: np.ndarray, centers: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, codes) of unit vectors."""
    own = np.argmax(vectors @ centers.T, axis=1)
    cut = _cut(vectors - centers[own])
    return own, np.stack([_nearest(points, book) for points, book in zip(cut, books)], axis=1).astype(np.uint8)


def build(chunks: DataFrame, dimensions: int, lists: int | None = None, sample_rows: int = 20_000, seed: int = 7, path: str | None = None) -> Index:
    """Index every chunk (chunk_id, embedding) with finite numbers and a length, in ``lists`` lists (by default
    as many as fit the number of rows). Centres and codes are fitted on ``sample_rows`` chunks at most, those
    of least hash of the id. With a ``path``, the index can be loaded again from there."""
    spark, kind = chunks.sparkSession, chunks.schema["embedding"].dataType.simpleString()
    usable = chunks.filter(is_finite(F.col("embedding"), dimensions) & F.exists("embedding", lambda x: x != 0)).select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    rows = usable.count()
    lists = dense.lists_for(rows) if lists is None else lists
    sample = np.array([r[0] for r in usable.orderBy(F.xxhash64("chunk_id", F.lit(seed))).limit(sample_rows).select("embedding").collect()], np.float64).reshape(-1, dimensions)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centers = dense._centers(sample, lists, seed, 10) if len(sample) else np.zeros((1, dimensions))
    books = fit_books(sample - centers[np.argmax(sample @ centers.T, axis=1)], seed)

    step = max(1, dense.TILE // len(centers))  # products with all centres are held for so many rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, step) for b in batches for i in range(0, len(b), step)):
            vectors = dense._matrix(batch.column(1), dimensions)
            own, codes = encoded(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), centers, books)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(own, pa.int32())], ["chunk_id", "code", "embedding", "list"])

    path = path or shared_path(spark, "quantized")
    files = max(1, rows // (len(centers) * FILE_ROWS))
    coded = usable.mapInArrow(assign, f"chunk_id long, code binary, embedding {kind}, list int")
    coded.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(files))).sortWithinPartitions("list", "chunk_id").write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    spark.createDataFrame([(i, b.ravel().tolist()) for i, b in enumerate(books)], "pair int, codes array<double>").coalesce(1).write.parquet(f"{path}/books")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    centers = [r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()]  # 4096 at most
    books = [r["codes"] for r in spark.read.parquet(f"{path}/books").orderBy("pair").collect()]  # one for two dimensions
    rows = spark.read.schema("chunk_id long, code binary, embedding array<float>, list int").parquet(f"{path}/rows")
    return Index(np.array(centers), np.array(books).reshape(len(books), CODES, PAIR), rows)


def decoded(codes: np.ndarray, lists: np.ndarray, centers: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for: what is coded, beside the centre. A product with one is the product with the
    centre and one entry of a table for each code."""
    return centers[lists] + np.concatenate([book[code] for book, code in zip(books, codes.T)], axis=1)[:, : centers.shape[1]]


def _candidates(ids: list, vectors: np.ndarray, index: tuple[np.ndarray, np.ndarray], probes: np.ndarray, short: int):
    """Batches (chunk_id, code, list) to the ``short`` nearest of the task by coded product, for each query. A task
    holds ``short`` rows a query and TILE products."""
    centers, books = index
    asked = probes.sum(axis=0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, read = dense.Nearest(len(ids), short), 0
        for batch in batches:
            if not len(batch):
                continue
            chunk, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
            coded = decoded(codes, lists, centers, books)
            read += int(asked[lists].sum())
            for asking in dense.tiles(np.arange(len(ids)), len(batch)):
                kept.add(asking, chunk, np.where(probes[asking][:, lists], -(vectors[asking] @ coded.T), np.nan), lists)
        row, column = np.nonzero(~np.isnan(kept.distance))
        columns = [pa.array([ids[r] for r in row]), pa.array(kept.chunk[row, column]), pa.array(kept.more[row, column]), pa.array(-kept.distance[row, column]), pa.array(np.r_[read, np.zeros(max(0, len(row) - 1), int)][: len(row)], pa.int64())]
        if len(row):
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "list", "product", "codes"])

    return work


def _exact(ids: list, vectors: np.ndarray):
    """Batches (query_id, chunk_id, embedding) to (query_id, chunk_id, distance)."""
    place = {q: i for i, q in enumerate(ids)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                matrix = dense._matrix(batch.column(2), vectors.shape[1])
                asked = vectors[[place[q] for q in batch.column(0).to_pylist()]]
                distance = np.round(1 - (matrix * asked).sum(1) / np.linalg.norm(matrix, axis=1), dense.DIGITS)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance)], ["query_id", "chunk_id", "distance"])

    return work


@dataclass(frozen=True)
class Found:
    rows: DataFrame  # query_id, rank, chunk_id, cosine_distance, cosine_similarity
    short: DataFrame  # query_id, chunk_id, list, product, codes: the short list, and codes read, in one row a query
    codes: int  # that were read, vectors of the short lists, and lists that hold these: as the search's jobs saw it
    vectors: int
    lists: int


def search(queries: DataFrame, index: Index, k: int, dimensions: int, nprobe: int | None = None, short: int | None = None) -> Found:
    """The k nearest of each query (query_id, embedding) among the ``short`` (by default SHORT times k) whose
    codes come nearest, over the ``nprobe`` lists nearest to the query (by default three quarters of all: codes
    are cheap, and data without clusters needs many lists)."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark, of = index.chunks.sparkSession, queries.schema["query_id"].dataType.simpleString()
    short, nprobe = max(k, SHORT * k if short is None else short), -(-3 * len(index.centers) // 4) if nprobe is None else nprobe
    found = near = None
    codes = whole_vectors = 0
    lists: set[int] = set()
    for ids, vectors in dense.query_blocks(queries, dimensions):
        probes = dense._nearest_mask(vectors, index.centers, nprobe)
        rows = index.chunks.select("chunk_id", "code", "list")
        if not probes.any(axis=0).all():
            rows = rows.filter(F.col("list").isin(np.flatnonzero(probes.any(axis=0)).tolist()))
        each = rows.mapInArrow(_candidates(ids, vectors, (index.centers, index.books), probes, short), f"query_id {of}, chunk_id long, list int, product double, codes long")
        order = Window.partitionBy("query_id").orderBy(F.desc("product"), "chunk_id")
        read = F.sum("codes").over(Window.partitionBy("query_id"))
        seen = Observation(f"short {uuid.uuid4().hex}")
        cut = each.withColumn("n", F.row_number().over(order)).withColumn("codes", F.when(F.col("n") == 1, read).otherwise(0)).filter(F.col("n") <= short).drop("n")
        cut = written(cut.observe(seen, F.sum("codes").alias("codes"), F.count(F.lit(1)).alias("vectors")), "short")
        codes, whole_vectors = codes + (seen.get["codes"] or 0), whole_vectors + seen.get["vectors"]
        held = [r[0] for r in cut.select("list").distinct().collect()]  # lists, 4096 at most
        lists |= {*held}
        whole = index.chunks.filter(F.col("list").isin(held)).select("chunk_id", "list", "embedding").join(cut.select("query_id", "chunk_id", "list"), ["chunk_id", "list"])
        scored = whole.select("query_id", "chunk_id", "embedding").mapInArrow(_exact(ids, vectors), f"query_id {of}, chunk_id long, distance double")
        if found is not None:
            scored = written(scored, "nearest")
        found, near = (scored, cut) if found is None else (found.unionByName(scored), near.unionByName(cut))
    if found is None:
        found = spark.createDataFrame([], f"query_id {of}, chunk_id long, distance double")
        near = spark.createDataFrame([], f"query_id {of}, chunk_id long, list int, product double, codes long")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return Found(ranked.select("query_id", "rank", "chunk_id", F.col("distance").alias("cosine_distance"), (1 - F.col("distance")).alias("cosine_similarity")), near, codes, whole_vectors, len(lists))


def ann_topk(queries: DataFrame, index: Index, k: int, dimensions: int, nprobe: int | None = None, short: int | None = None) -> DataFrame:
    return search(queries, index, k, dimensions, nprobe, short).rows


def bytes_share(found: Found, index: Index, rows: int) -> DataFrame:
    """One row: queries, codes and vectors read for them, and ``share``, their bytes against those of all vectors of
    ``rows`` rows, which an exact search reads for each query."""
    code, vector = index.books.shape[0], 4 * index.centers.shape[1]
    sums = found.short.agg(F.countDistinct("query_id").alias("queries"), F.sum("codes").alias("codes"), F.count("*").alias("vectors"))
    return sums.withColumn("share", (F.col("codes") * code + F.col("vectors") * vector) / (F.col("queries") * rows * vector))
