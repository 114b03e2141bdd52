"""Token ids in files: frequency-ranked codes, byte-aligned, with separate control bytes.

An id's code is its rank by frequency in the corpus, so frequent ids have small codes. A code takes
one to four bytes, least significant first; two bits of a control byte say how many, four codes to a
control byte. A file row is a block of consecutive documents: control bytes, code bytes, and each
document's number of ids; a document begins with a control byte of its own. Files are Parquet, which any store that Spark reaches can hold, and the
table of ranks lies beside them. Blocks are decoded by numpy: a table gives a control byte's four
lengths, their running sum the place of each code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import tokens
from tarn.shared import written

#: Ids of a block at most, unless one document alone has more.
BLOCK_IDS = 1 << 18
#: Bytes of ids of one file at about this figure.
FILE_BYTES = 64 << 20
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack_documents(codes: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(control bytes, code bytes) of each document; rows[i]:rows[i+1] are the codes of document i."""
    codes = np.ascontiguousarray(codes, "<u4")
    counts = np.diff(rows)
    room = -(-counts // 4) * 4
    extra = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    fours = np.zeros(int(room.sum()), np.uint8)
    fours[_places(counts, room)] = extra
    fours = fours.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    data = codes.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    ends = np.concatenate([[0], np.cumsum(extra + 1, dtype=np.int64)])
    return _binary(control, np.concatenate([[0], np.cumsum(room // 4)])), _binary(data, ends[rows])


def _places(counts: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Where each code stands if every document has room for whole fours."""
    return np.arange(int(counts.sum())) + np.repeat(np.cumsum(room - counts) - (room - counts), counts)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pack_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, code bytes) of one document's unsigned 32-bit codes."""
    control, data = pack_documents(codes, np.array([0, len(codes)]))
    return control[0].as_py(), data[0].as_py()


def unpack_codes(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The codes of documents with these counts, whose bytes by ``pack_codes`` follow each other."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    lengths = lengths[_places(counts, -(-counts // 4) * 4)]  # a document's last control byte may tell of fewer than four
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    codes = np.zeros(len(lengths), np.uint32)
    for k in range(4):
        has = lengths > k
        if has.any():
            codes[has] |= raw[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return codes


def _cuts(batch: pa.RecordBatch, column: int, id_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about BLOCK_IDS ids of a binary column, so that memory does not follow the batch."""
    ends, i = np.cumsum(pc.binary_length(batch.column(column)).to_numpy()) // id_bytes, 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_IDS, "right")))
        yield batch.slice(i, j - i)
        i = j


def _ids(column: pa.Array, id_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column without nulls, and the offsets of each row's."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), f"<u{id_bytes}"), (offsets - offsets[0]) // id_bytes


def _counts(id_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cut in _cuts(batch, 0, id_bytes):
                got = np.bincount(_ids(cut.column(0), id_bytes)[0])
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return work


def frequency_ranks(encoded: DataFrame, id_bytes: int = 4) -> np.ndarray:
    """Ids by falling frequency (ties: smaller id first). At most one entry for each id of the
    tokenizer's vocabulary, whatever the size of the corpus."""
    rows = encoded.select("ids").mapInArrow(_counts(id_bytes), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def _bounds(numbered: DataFrame, files: int) -> tuple[np.ndarray, np.ndarray]:
    """The last (doc_id, row) of each of ``files`` ranges of about equal numbers of rows, in order. Only
    these two numbers of each row are dealt out for it."""
    ranges = numbered.select("doc_id", "row").repartitionByRange(files, "doc_id", "row").withColumn("range", F.spark_partition_id()).groupBy("range").agg(F.max(F.struct("doc_id", "row")).alias("last"))
    last = sorted((r["last"]["doc_id"], r["last"]["row"]) for r in ranges.collect())[:-1]
    return np.array([d for d, _ in last], np.int64), np.array([r for _, r in last], np.int64)


def _range_of(doc: np.ndarray, row: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds lie before each (doc, row)."""
    low, high = np.searchsorted(bounds[0], doc, "left"), np.searchsorted(bounds[0], doc, "right")
    for i in np.flatnonzero(high > low):  # bounds of the same document: by row
        low[i] += np.searchsorted(bounds[1][low[i] : high[i]], row[i], "left")
    return low.astype(np.int32)


def _to_codes(ranked: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], id_bytes: int):
    """(doc_id, row, ids) to each document's range, control and code bytes: what is dealt out is compact."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        code_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
        code_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
        for batch in batches:
            for cut in _cuts(batch, 2, id_bytes):
                ids, rows = _ids(cut.column(2), id_bytes)
                part = _range_of(cut.column(0).to_numpy(), cut.column(1).to_numpy(), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(part), cut.column(0), cut.column(1), pa.array(np.diff(rows)), *pack_documents(code_of[ids], rows)], ["part", "doc_id", "row", "n", "control", "codes"])

    return work


_BLOCK = "part long, block long, doc_ids array<long>, lengths array<long>, control binary, codes binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, n, control, codes), in order, to blocks."""
    tokens.forget()
    block = 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        rows = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(rows, rows[i] + BLOCK_IDS, "right")) - 1)
            cut = batch.slice(i, j - i)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([cut.column(0)[0].as_py()], pa.int64()), "block": pa.array([block], pa.int64()), "doc_ids": pa.array([cut.column(1).to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([n[i:j]], pa.list_(pa.int64())),
                "control": pa.array([b"".join(cut.column(3).to_pylist())], pa.binary()), "codes": pa.array([b"".join(cut.column(4).to_pylist())], pa.binary()),
            })
            i, block = j, block + 1


def write_ids(encoded: DataFrame, path: str, identity: str = "doc_id", id_bytes: int = 4, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of ``encoded`` (``identity``, and binary ``ids`` of ``id_bytes`` bytes each) in
    ascending order of identity.

    ``path/ranks`` gets the ids by falling frequency, ``path/blocks`` the blocks, with the file's place
    in the order in the column ``part``. Equal identities follow each other in arbitrary order, a null
    one comes first, a null ``ids`` counts as empty. ``encoded`` is read four times: give a written table.
    """
    spark = encoded.sparkSession
    narrow = encoded.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    size = narrow.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranked = frequency_ranks(narrow, id_bytes)
    spark.createDataFrame([(int(k), int(v)) for k, v in enumerate(ranked)], "code long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    files = max(1, -(-size // file_bytes), spark.sparkContext.defaultParallelism)
    # rows of one identity may lie in several files: their place in the input is the second key
    first = F.lit(np.iinfo(np.int64).min)
    numbered = narrow.select(F.coalesce("doc_id", first).alias("doc_id"), F.monotonically_increasing_id().alias("row"), "ids")
    bounds = _bounds(numbered, files)
    coded = numbered.mapInArrow(_to_codes(ranked, bounds, id_bytes), "part int, doc_id long, row long, n long, control binary, codes binary")
    ordered = coded.repartitionById(len(bounds[0]) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "row")
    ordered = ordered.select("part", F.nullif("doc_id", first).alias("doc_id"), "n", "control", "codes")
    ordered.mapInArrow(_to_blocks, _BLOCK).write.parquet(f"{path}/blocks")


def _from_blocks(ranked: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for r in range(len(batch)):
                docs, lengths = batch.column("doc_ids")[r].values, batch.column("lengths")[r].values.to_numpy()
                ids = ranked[unpack_codes(batch.column("control")[r].as_py(), batch.column("codes")[r].as_py(), lengths)].astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                raw = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids)])
                start = batch.column("start")[r].as_py() + offsets[:-1]
                yield pa.RecordBatch.from_pydict({"doc_id": docs, "start": pa.array(start, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids": raw})

    return work


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit
    little-endian), read from the files alone."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # at most the tokenizer's vocabulary
    ranked = np.zeros(len(ranks), np.uint32)
    for code, i in ranks:
        ranked[code] = i
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("n", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    # places of parts, then of blocks in their part; a part is a file, so no window holds many rows
    parts = blocks.groupBy("part").agg(F.sum("n").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    starts = written(blocks.select("part", "block", "n").withColumn("inside", inside).join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start")), "starts")
    placed = blocks.join(F.broadcast(starts) if _small(starts) else starts, ["part", "block"])
    return placed.select("doc_ids", "lengths", "control", "codes", "start").mapInArrow(_from_blocks(ranked), "doc_id long, start long, n_tokens long, ids binary")


#: Block starts are broadcast up to this number of rows (24 bytes each); beyond it they are joined.
BROADCAST_STARTS = 100_000


def _small(starts: DataFrame) -> bool:
    return starts.count() <= BROADCAST_STARTS
