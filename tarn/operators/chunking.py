"""Chunks of structured documents: greedy packing of blocks inside a section, with overlap.

Input rows hold ``blocks``, an array of structs (kind, text, heading_path, section_root) in document
order. The fold runs inside a row, so chunking needs no shuffle whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import retrieval_text, sha256

VERSION = "markdown-structure-v2"

_CHUNKS = "array<struct<heading_path:array<string>,raw:string>>"


@dataclass(frozen=True)
class ChunkLimits:
    """Characters: a chunk is closed at ``target``, never exceeds ``maximum``, and begins with
    ``overlap`` of the one before."""

    target: int = 1600
    maximum: int = 2200
    overlap: int = 200

    def __post_init__(self):
        if self.target <= 0:
            raise ValueError("target must be positive")
        if self.maximum < self.target:
            raise ValueError("maximum must be at least target")
        if not 0 <= self.overlap < self.target:
            raise ValueError("overlap must be from 0 to below target")


def windows(text: Column, maximum: int, overlap: int) -> Column:
    """Windows of ``maximum`` characters, each starting ``maximum - overlap`` after the last."""
    step = maximum - overlap
    count = F.ceil((F.length(text) - overlap) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substring(text, i * step + 1, F.lit(maximum)))


def pack_blocks(blocks: Column, limits: ChunkLimits) -> Column:
    """Array of (heading_path, raw) of one document's blocks."""
    empty_path = F.array().cast("array<string>")
    start = F.struct(F.array().cast(_CHUNKS).alias("done"), F.lit("").alias("open"), empty_path.alias("path"), F.lit("").alias("root"))

    def closed(state: Column) -> Column:
        one = F.array(F.struct(state["path"].alias("heading_path"), state["open"].alias("raw")))
        return F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], one))

    def step(state: Column, block: Column) -> Column:
        text, path, root = block["text"], block["heading_path"], block["section_root"]
        same = (state["path"] == path) & (state["root"] == root)
        current = F.when(same, state["open"]).otherwise(F.lit(""))
        joined = F.concat(current, F.lit("\n\n"), text)
        large = F.length(text) > limits.maximum
        fits = (F.length(current) < limits.target) & (F.length(joined) <= limits.maximum)
        seeded = F.concat(F.expr("''") if not limits.overlap else F.right(current, F.lit(limits.overlap)), F.lit("\n\n"), text)
        fresh = F.when(F.lit(limits.overlap > 0) & (F.length(seeded) <= limits.maximum), seeded).otherwise(text)
        pieces = F.transform(windows(text, limits.maximum, limits.overlap), lambda w: F.struct(path.alias("heading_path"), w.alias("raw")))
        goes_on = same & ~large & ((current == "") | fits)
        done = F.when(goes_on, state["done"]).when(large, F.concat(closed(state), pieces)).otherwise(closed(state))
        open_text = F.when(large, F.lit("")).when(current == "", text).when(fits, joined).otherwise(fresh)
        return F.struct(done.alias("done"), open_text.alias("open"), path.alias("path"), root.alias("root"))

    return F.aggregate(blocks, start, step, closed)


def chunk_documents(documents: DataFrame, limits: ChunkLimits | None = None, blocks: str = "blocks", title: str = "title") -> DataFrame:
    """A row for each chunk: the document's other columns, chunk_index (from 0), chunker_version,
    heading_path, content_raw, retrieval_text, char_count and content_hash. A document without blocks
    gives none."""
    limits = limits or ChunkLimits()
    rest = [F.col(f"`{c}`") for c in documents.columns if c != blocks]
    rows = documents.select(*rest, F.posexplode(pack_blocks(F.col(blocks), limits)).alias("chunk_index", "chunk"))
    text = retrieval_text(F.col(title), F.col("chunk.heading_path"), F.col("chunk.raw"))
    rows = rows.select(*rest, "chunk_index", F.lit(VERSION).alias("chunker_version"), "chunk.heading_path", F.col("chunk.raw").alias("content_raw"), text.alias("retrieval_text"))
    return rows.select("*", F.length("content_raw").alias("char_count"), sha256(F.col("retrieval_text")).alias("content_hash"))


def plain_blocks(text: Column) -> Column:
    """Blocks of a text without markup: its paragraphs, in one section without headings."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(paragraphs, lambda p: F.struct(F.lit("paragraph").alias("kind"), p.alias("text"), F.array().cast("array<string>").alias("heading_path"), F.lit("").alias("section_root")))
