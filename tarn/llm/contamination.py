"""Benchmark decontamination: a prefix-filtered set join with exact windows of benchmark items.

An item gives windows of ``n`` consecutive words (a shorter item is one window). The words of a
window are ordered by rarity, that is by the number of documents that hold them. Containment must be
total, so a prefix of one word is enough: a document can hold a window only where it holds its
rarest word. Documents are joined with the windows on that word; the word's place in the window
bounds where the window would start and end in the row; what is left is compared word for word.

Items come in blocks of at most ``block_windows`` windows. A block is small by construction and goes
to every task; all documents are read for each block, so neither side needs to fit anywhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.rows import passing, schema
from tarn.llm.words import ALNUM, FOLD, Words, covered, mix, row_sums, runs, split
from tarn.shared import written

WINDOW = 13
BLOCK_WINDOWS = 200_000
_POWER = np.uint64(0x9E3779B97F4A7C15)

_FOUND = "n_words long, n_hit long, spans array<struct<first:int,last:int>>, items array<string>"


def _windows(n: int):
    """Benchmark batches (item, text) to rows of its windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            for i, j, data, offsets in runs(batch.column(1)):
                w = split(data, offsets, ALNUM, FOLD)
                item, window = [], []
                for row in range(i, j):
                    a, b = w.rows[row - i], w.rows[row - i + 1]
                    if items[row] is not None and b > a:
                        found = {w.text(s, min(s + n, b)) for s in range(a, max(a + 1, b - n + 1))}
                        item += [items[row]] * len(found)
                        window += found
                yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.string()), "window": pa.array(window, pa.binary())})

    return work


def _one_hash(words: list[bytes]) -> np.ndarray:
    data = b" ".join(words)
    return split(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM, FOLD).hash


def _rarity(vocabulary: np.ndarray):
    """Document batches (text) to (word, documents): in how many rows each vocabulary word stands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for i, j, data, offsets in runs(batch.column(0)):
                w = split(data, offsets, ALNUM, FOLD)
                if not len(vocabulary):
                    continue
                at = np.searchsorted(vocabulary, w.hash)
                at[at == len(vocabulary)] = 0
                known = vocabulary[at] == w.hash
                pairs = np.unique(w.row_of()[known] * len(vocabulary) + at[known])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.int64()), "documents": pa.array(total[seen], pa.int64())})

    return work


def _fold_words(hashes: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix of word hashes."""
    out = np.zeros(len(hashes), np.uint64)
    for j in range(hashes.shape[1]):
        out = out * _POWER + hashes[:, j]
    return mix(out)


class _Block:
    """The windows of one block, by length and hash, and the rarest word of each."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        items = defaultdict(list)
        for item, window in rows:
            items[bytes(window)].append(item)
        self.windows = sorted(items)
        self.items = [sorted(set(items[w])) for w in self.windows]
        self.hashes = [_one_hash(w.split(b" ")) for w in self.windows]
        self.vocabulary = np.unique(np.concatenate([*self.hashes, np.zeros(0, np.uint64)]))

    def index(self, rarity: np.ndarray) -> None:
        """Order the words of each window by rarity and keep the first: {(length, its place): (sorted
        words to look for)} and {length: (sorted window hashes, their windows)}."""
        places, by_length = defaultdict(set), defaultdict(list)
        for k, h in enumerate(self.hashes):
            count = rarity[np.searchsorted(self.vocabulary, h)]
            at = int(np.lexsort((np.arange(len(h)), h, count))[0])
            places[len(h), at].add(h[at])
            by_length[len(h)].append((int(_fold_words(h[None, :])[0]), k))
        self.places = {k: np.array(sorted(v), np.uint64) for k, v in places.items()}
        self.prefix = np.unique(np.concatenate([*self.places.values(), np.zeros(0, np.uint64)]))
        self.by_length = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)])) for k, v in by_length.items()}
        self.hashes = None

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, window) of every occurrence in the rows of ``w``."""
        none = np.zeros(0, np.int64)
        row = w.row_of()
        spots = np.flatnonzero(np.isin(w.hash, self.prefix))
        out = [(none, none, none)]
        for (length, at), words in self.places.items():
            first = spots[np.isin(w.hash[spots], words)] - at
            first = first[(first >= 0) & (first + length <= len(row))]
            first = first[(row[first] == row[first + at]) & (row[first + length - 1] == row[first + at])]
            if not len(first):
                continue
            hashes, window = self.by_length[length]
            got = _fold_words(w.hash[first[:, None] + np.arange(length)])
            low, high = np.searchsorted(hashes, got), np.searchsorted(hashes, got, "right")
            hit = [(s, s + length, k) for s, a, b in zip(first[high > low], low[high > low], high[high > low]) for k in window[a:b] if w.text(s, s + length) == self.windows[k]]
            if hit:
                out.append(tuple(np.array(hit, np.int64).T))
        first, last, window = (np.concatenate(x) for x in zip(*out))
        _, once = np.unique(np.stack([first, window]), axis=1, return_index=True)
        return first[once], last[once], window[once]


def _search(block: _Block, keep: int):
    """Document batches (kept columns, then text) to the kept columns and what was found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in runs(batch.column(keep)):
                w = split(data, offsets, ALNUM, FOLD)
                first, last, window = block.occurrences(w)
                mask = covered(first, last, len(w.start))
                row = w.row_of()
                items = [set() for _ in range(i, j)]
                for r, k in zip(row[first].tolist(), window.tolist()):
                    items[r].update(block.items[k])
                edge = np.flatnonzero(mask & ~(np.r_[False, mask[:-1]] & np.r_[False, row[1:] == row[:-1]])[: len(mask)])
                stop = np.flatnonzero(mask & ~(np.r_[mask[1:], False] & np.r_[row[1:] == row[:-1], False])[: len(mask)]) + 1
                spans = [[] for _ in range(i, j)]
                for a, b in zip(edge.tolist(), stop.tolist()):
                    spans[row[a]].append({"first": a - w.rows[row[a]], "last": b - w.rows[row[a]]})
                cut = batch.slice(i, j - i)
                columns = [cut.column(c) for c in range(keep)]
                columns += [
                    pa.array(w.count(), pa.int64()),
                    pa.array(row_sums(mask, w.rows), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*(f"k{c}" for c in range(keep)), "n_words", "n_hit", "spans", "items"])

    return work


def _in_block(documents: DataFrame, keep: list[str], text: str, block: _Block) -> DataFrame:
    counted = documents.select(F.col(f"`{text}`").alias("text")).mapInArrow(_rarity(block.vocabulary), "word long, documents long").groupBy("word").agg(F.sum("documents").alias("documents"))
    rarity = np.zeros(len(block.vocabulary), np.int64)
    for word, n in counted.collect():  # at most a row for each word of the block
        rarity[word] = n
    block.index(rarity)
    return documents.select(*passing(keep), F.col(f"`{text}`").alias("text")).mapInArrow(_search(block, len(keep)), schema(documents, keep, _FOUND))


def find_benchmark(
    documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Where benchmark items stand in documents.

    Returns a row for each row of ``documents``: its columns named in ``keep``, in that order, then
    ``n_words``; ``n_hit``, the words inside any occurrence of a window; ``spans``, those words as
    merged ranges of word numbers; and ``items``, the ids of items with an occurring window, as
    sorted strings. Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
    characters. Null and empty texts have no words; items without words or id match nothing; repeated
    rows and items with equal text each count for themselves. Columns may have any name, dots
    included, but ``keep`` may not hold the new names; other columns are not read.
    """
    windows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")).mapInArrow(_windows(n), "item string, window binary")
    windows = written(windows.distinct(), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    parts = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    if blocks == 1:
        found = _in_block(documents, keep, text, _Block(windows.collect()))
    else:
        # the rows get a number that stays the same for every block, and their findings meet by it; kept
        # columns go by k0, k1, ... from here on, so none of their names can clash with it
        numbered = written(documents.select(*passing(keep), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
        each = [_in_block(numbered, ["row"], "text", _Block([tuple(r) for r in parts.filter(F.col("block") == b).select("item", "window").collect()])) for b in range(blocks)]
        union = each[0]
        for one in each[1:]:
            union = union.unionByName(one)
        met = union.groupBy(F.col("k0").alias("row")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = F.aggregate(
            "spans", F.expr("cast(array() as array<struct<first:int,last:int>>)"),
            lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))),
            ).otherwise(F.concat(done, F.array(s))),
        )
        met = met.withColumn("spans", merged).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"]))
        found = numbered.drop("text").join(met, "row").select(*(f"k{i}" for i in range(len(keep))), "n_words", "n_hit", "spans", "items")
    return found.toDF(*keep, "n_words", "n_hit", "spans", "items")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one twentieth of the document's words, and one word, lie in benchmark windows."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
