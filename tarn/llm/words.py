"""Words of whole Arrow batches at once: boundaries and 64-bit hashes with numpy, no loop over rows.

The functions take the UTF-8 bytes of a text column as they lie in Arrow. A word is a maximal run of
word bytes within one row; ``WHITE`` splits at ASCII white space, ``ALNUM`` keeps a-z, 0-9 and all
non-ASCII characters after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

WHITE = np.ones(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Rows are worked on in runs of about so many bytes: memory does not follow the batch size, and the
#: arrays of a run stay in the processor's cache.
RUN_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place where ``h`` owns its memory)."""
    h = h ^ (h >> np.uint64(29))
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


@dataclass
class Words:
    """Words of some rows: byte ranges in ``data``, hashes, and ``rows[i]:rows[i+1]`` for row i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def texts(self) -> pa.Array:
        """Each word's bytes."""
        n = self.end - self.start
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1]) + np.repeat(self.start - ends[:-1], n)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data[at]))])

    def joined(self, which: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
        """For each group from 0 to groups - 1 the words ``which`` of it, in that order, joined by one
        space; ``group`` is the group of each and never falls."""
        space = np.r_[group[1:] == group[:-1], False][: len(group)].astype(np.int64)
        n = self.end[which] - self.start[which] + space
        ends = np.concatenate([[0], np.cumsum(n)])
        source = np.arange(ends[-1]) + np.repeat(self.start[which] - ends[:-1], n)
        out = self.data[np.minimum(source, max(0, len(self.data) - 1))] if len(source) else np.zeros(0, np.uint8)
        out[ends[1:][space > 0] - 1] = 0x20
        offsets = ends[np.searchsorted(group, np.arange(groups + 1))].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), groups, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out))])

    def spans(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """Words first..last-1 of each span, joined by one space."""
        which, span = ranges(first, last)
        return self.joined(which, span, len(first))

    def text(self, first: int, last: int) -> bytes:
        """Words first..last-1 joined by one space."""
        d = self.data
        return b" ".join(d[a:b].tobytes() for a, b in zip(self.start[first:last], self.end[first:last]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with about run_bytes each."""
    data, offsets = utf8(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WHITE, fold: np.ndarray = SAME, hashed: bool = True) -> Words:
    """The words of rows; without ``hashed``, which takes about half of the time, there are no hashes."""
    if fold is not SAME:
        data = fold[data]
    n = len(data)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not hashed:
        return Words(data, start, end, np.zeros(0, np.uint64), np.searchsorted(start, offsets))
    # a value of its own for each byte at each place of a word: sums of these have no algebra that
    # words could be built against, as a polynomial of the bytes has
    ends = np.cumsum(end - start)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.uint64) - np.repeat((ends - (end - start)).astype(np.uint64), end - start)
    value = mix(_BYTE[data[inside]] ^ (at * _MIX))
    sums = np.add.reduceat(value, ends - (end - start)) if len(ends) else value
    return Words(data, start, end, mix(sums + (end - start).astype(np.uint64) * _ODD), np.searchsorted(start, offsets))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive hashes from each place on; runs over row ends, see ``whole``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * _ODD + h[j : len(h) - n + 1 + j]
    return mix(out)


def whole(words: Words, n: int) -> np.ndarray:
    """Places from which n words lie in one row, in order."""
    row = words.row_of()
    if len(row) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers from first to last - 1 of each range, the range of each)."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n), np.repeat(np.arange(len(n)), n)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Boolean mask of the places that some range [start, end) covers."""
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark[:-1]) > 0


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values[rows[i]:rows[i+1]]; empty rows give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[rows[1:]] - total[rows[:-1]]
