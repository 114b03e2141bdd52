"""Text expressions of the retrieval engine; all run inside the JVM, but for ``term_counts``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of Han characters to its words, in place of pairs; say, a dictionary's search mode.
Segmenter = Callable[[str], list[str]]

# What counts as a term, and the Han ranges.
TERM = r"[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*|[㐀-䶿一-鿿]+|\p{Nd}+(?:\.\p{Nd}+)?"
HAN = r"^[㐀-䶿一-鿿]"
#: Characters that may be Han or digits beyond ASCII: without them, terms are ASCII and ``term_counts`` finds them.
BEYOND = r"[^\x00-\x{63F}]"
ASCII_TERM = rb"[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*|[0-9]+(?:\.[0-9]+)?"
#: Bytes of text whose terms are counted at a time.
SLICE_BYTES = 1 << 20
# Labels of a chunk's retrieval text.
TITLE_LABEL, SECTION_LABEL, PREAMBLE = ("[文档：", "]"), ("[章节：", "]"), "（文档正文）"

TOKENIZER_VERSION = "han-bigram-code-v1"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def han_bigrams(run: Column) -> Column:
    """Overlapping pairs of a run of Han characters; one character is itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.length(run) < 2, F.array(run)).otherwise(pairs)


def _segmented(segmenter: Segmenter):
    pattern, han = re.compile(TERM.replace(r"\p{Nd}", r"\d")), re.compile(HAN)

    @F.pandas_udf("array<string>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [w for run in pattern.findall(t or "") for w in (segmenter(run) if han.match(run) else [run.lower()]) if w.strip()])

    return work


def terms(text: Column, segmenter: Segmenter | None = None) -> Column:
    """Search terms of a text in order: lower-cased identifiers, numbers, and Han bigrams, or what the
    segmenter makes of a Han run. Null has none."""
    if segmenter is not None:
        return _segmented(segmenter)(text)
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0))
    # most texts have no Han character: their runs need no look at each
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(HAN), han_bigrams(r)).otherwise(F.array(F.lower(r)))))
    return F.when(F.coalesce(text, F.lit("")).rlike(HAN[1:]), cut).otherwise(F.transform(runs, F.lower))


def has_ascii_terms(text: Column) -> Column:
    """Whether ``term_counts`` can find the terms by itself; false for null."""
    return F.coalesce(~text.rlike(BEYOND), F.lit(False))


_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _ascii_terms(texts: pa.Array, mine: np.ndarray) -> tuple[list[pa.Array], list[np.ndarray]]:
    """(terms, the row of each) of the rows ``mine``: runs of letters, digits and underscores, all at once; rows that have
    points within terms, or digits or underscores right before letters, one by one."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    inside = _IN_TERM[data] & mine[row]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    last[:-1] &= ~inside[1:] | (row[1:] != row[:-1])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    odd = np.zeros(len(texts), bool)
    points = np.flatnonzero(data == 0x2E)
    points = points[(points > 0) & (points < len(data) - 1)]
    odd[row[points[inside[points - 1] & inside[points + 1] & (row[points - 1] == row[points + 1])]]] = True
    others = np.concatenate([[0], np.cumsum(inside & ~_DIGIT[data])])
    begins = data[start]
    odd[row[start[(_DIGIT[begins] | (begins == 0x5F)) & (others[end] > others[start])]]] = True
    inside &= ~odd[row]
    start, end = (x[~odd[row[start]]] for x in (start, end))
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    terms, rows = [pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])])], [row[start]]
    for r in np.flatnonzero(odd).tolist():
        found = re.findall(ASCII_TERM, data[offsets[r] : offsets[r + 1]].tobytes().lower())
        terms.append(pa.array(found, pa.binary()).cast(pa.string()))
        rows.append(np.full(len(found), r))
    return terms, rows


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text, its terms where ``has_ascii_terms`` is false) to (id, dl, counts): the number of its terms, and
    each with how often it stands there."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *np.searchsorted(size, np.arange(SLICE_BYTES, size[-1] if len(size) else 0, SLICE_BYTES)).tolist(), len(batch)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j == i:
                continue
            one = batch.slice(i, j - i)
            given = one.column(2)
            terms, rows = _ascii_terms(one.column(1), ~given.is_valid().to_numpy(zero_copy_only=False))
            more = pc.fill_null(given.value_lengths(), 0).to_numpy(zero_copy_only=False)
            row = np.concatenate([*rows, np.repeat(np.arange(len(one)), more)]).astype(np.int64)
            coded = pa.concat_arrays([*terms, given.flatten().cast(pa.string())]).dictionary_encode()
            n = max(1, len(coded.dictionary))
            pair, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(pair // n, np.arange(len(one) + 1)).astype(np.int32)
            dl = np.bincount(row, minlength=len(one)).astype(np.int64)
            counts = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % n)), pa.array(tf.astype(np.int64))], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([one.column(0), pa.array(dl), pa.ListArray.from_arrays(pa.array(ends), counts)], ["chunk_id", "dl", "counts"])


def retrieval_text(title: Column, heading_path: Column, raw: Column) -> Column:
    """Title (where there is one), heading path and raw text, each on a line of its own."""
    path = F.when(F.size(heading_path) > 0, F.array_join(heading_path, " / ")).otherwise(F.lit(PREAMBLE))
    return F.concat_ws("\n", F.concat(F.lit(TITLE_LABEL[0]), title, F.lit(TITLE_LABEL[1])), F.concat(F.lit(SECTION_LABEL[0]), path, F.lit(SECTION_LABEL[1])), raw)


def preview(text: Column, length: int = 100) -> Column:
    """White space collapsed, cut to ``length`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length - 1), F.lit("…"))).otherwise(flat)
