"""Best-fit packing with a swap-based local search.

Pieces are dealt at random into groups of a bounded number of rows. A group is packed best fit, the
longest first; then documents are exchanged between underfull bins, one for one, two for one or by a
plain move, whenever that raises the sum of squared fills, with the emptiest bin as giver, so that
bins empty. What the groups leave in loose bins meets in fewer groups in the next round, until one
group is left or a round no longer shrinks the rest. All groups of a round run side by side.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import rows as rows_of
from tarn.shared import written

CAPACITY = 4096
GROUP_ROWS = 20_000
#: A bin with more than this share of its room free is loose: the next round packs its pieces again.
LOOSE = 1 / 64


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: the longest piece first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    frees = 0  # bit f is set where some bin has f free
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = frees >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                frees ^= 1 << free
            bins[b].append(k)
        else:
            free, b = capacity, len(bins)
            bins.append([k])
        with_free[free - size].append(b)
        frees |= 1 << (free - size)
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: for each cut k up to half the capacity, every piece
    longer than capacity - k is alone but for shorter ones than k, every piece over half the capacity has
    a bin of its own, and the pieces from k on need at least their total."""
    n = np.sort(lengths.astype(np.int64))
    sums = np.concatenate([[0], np.cumsum(n)])
    k = np.concatenate([[0], np.unique(n[2 * n <= capacity])])
    first, half, alone = np.searchsorted(n, k), np.searchsorted(2 * n, capacity, "right"), np.searchsorted(n, capacity - k, "right")
    own = len(n) - half
    room = (alone - half) * capacity - (sums[alone] - sums[half])  # beside those of over half
    more = -(-np.maximum(0, sums[half] - sums[first] - room) // capacity)
    return int((own + more).max(initial=0))


class _Search:
    """Bins that are not full, by what they hold and by how much is free in them.

    Sizes are whole numbers up to the capacity, so what is looked up (the fullest bin that a size fits
    into, the shortest item that a size may replace) takes as long for many bins as for few."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items = [sorted((int(lengths[k]), k) for k in b) for b in bins]
        self.free = [capacity - sum(n for n, _ in b) for b in self.items]
        #: By size of an item: (free, bin) of all bins that hold one and may take; and size plus the most free.
        self.holders: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.reach = np.zeros(capacity + 1, np.int64)
        #: By room: the bins that have it free; and a bit for each room that some bin has.
        self.with_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.frees = 0

    def _note(self, size: int) -> None:
        held = self.holders[size]
        self.reach[size] = size + held[-1][0] if held else 0

    def add(self, b: int) -> None:
        """The bin may take."""
        free = self.free[b]
        if not free or not self.items[b]:
            return
        self.with_free[free].add(b)
        self.frees |= 1 << free
        for size in {n for n, _ in self.items[b]}:
            insort(self.holders[size], (free, b))
            self._note(size)

    def drop(self, b: int) -> None:
        free = self.free[b]
        if b not in self.with_free[free]:
            return
        self.with_free[free].remove(b)
        if not self.with_free[free]:
            self.frees ^= 1 << free
        for size in {n for n, _ in self.items[b]}:
            held = self.holders[size]
            held.pop(bisect_left(held, (free, b)))
            self._note(size)

    def _swap(self, giver: int, taker: int, given: list[tuple[int, int]], back: list[tuple[int, int]]) -> None:
        self.drop(taker)
        for x in given:
            self.items[giver].remove(x)
            insort(self.items[taker], x)
        for y in back:
            self.items[taker].remove(y)
            insort(self.items[giver], y)
        gain = sum(n for n, _ in given) - sum(n for n, _ in back)
        self.free[giver] += gain
        self.free[taker] -= gain
        self.add(taker)

    def exchange(self, giver: int) -> bool:
        """Make one exchange that fills another bin further at the giver's cost, if there is one. The
        giver has at least as much free as any bin that may take, so the sum of squared fills rises."""
        items = self.items[giver]
        for x in reversed(items):  # a move, into the fullest bin with room
            fits = self.frees >> x[0]
            if fits:
                free = x[0] + (fits & -fits).bit_length() - 1
                self._swap(giver, next(iter(self.with_free[free])), [x], [])
                return True
        # at most two items of each size: all that pairs can tell apart
        some = [x for i, x in enumerate(items) if i < 2 or items[i - 2][0] < x[0]]
        offers = {x[0]: [x] for x in some}
        for i, x in enumerate(some):
            for y in some[i + 1 :]:
                offers.setdefault(x[0] + y[0], [x, y])
        best, back = 0, 0
        for size, given in offers.items():  # one or two for the shortest item that they may replace
            if size - best > 1:
                at = self.reach[1 : min(size, self.capacity + 1) - best] >= size
                found = int(at.argmax()) if len(at) else 0
                if len(at) and at[found]:
                    best, back, most = size - found - 1, found + 1, given
        if not best:
            return False
        held = self.holders[back]
        taker = held[bisect_left(held, (best, -1))][1]
        self._swap(giver, taker, most, [next(y for y in self.items[taker] if y[0] == back)])
        return True


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search until no exchange is left or no fewer bins can hold the pieces.

    Turn by turn every bin gives, the emptiest first, until it is empty or has nothing that would fill
    another bin further; then it takes no part until the next turn. Every exchange raises the sum of
    squared fills, a whole number with an upper bound, so it ends."""
    search, least = _Search(bins, lengths, capacity), least_bins(lengths, capacity)
    used, moved = sum(1 for b in search.items if b), True
    while used > least and moved:
        moved = False
        for b in range(len(bins)):
            search.add(b)
        while search.frees and used > least:
            giver = next(iter(search.with_free[search.frees.bit_length() - 1]))
            search.drop(giver)
            while search.items[giver] and search.exchange(giver):
                moved = True
            used -= not search.items[giver]
        for b in range(len(bins)):
            search.drop(b)
    return [[k for _, k in b] for b in search.items if b]


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def _pack_group(capacity: int):
    def work(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        number, offset, loose = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for b, items in enumerate(pack_lengths(lengths, capacity)):
            n = lengths[items]
            number[items], offset[items], loose[items] = b, np.cumsum(n) - n, capacity - n.sum() > capacity * LOOSE
        return table.append_column("bin", pa.array(number)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))

    return work


def pack(pieces: DataFrame, keep: Sequence[str], length: str = "length", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Put every row of ``pieces`` into a sequence of at most ``capacity`` tokens.

    Returns a row for each row: the columns named in ``keep``, then ``sequence_id`` (long) and
    ``offset`` (long, the row's place in its sequence; gapless from 0). Lengths are whole numbers from
    1 to ``capacity``, else it raises; rows of full length are sequences as they are. Repeated rows
    are packed each for themselves; an empty table gives an empty table. ``keep`` may not hold the two
    new names; other columns are not read.
    """
    names = [f"k{i}" for i in range(len(keep))]
    narrow = pieces.select(*rows_of.passing(keep), F.col(f"`{length}`").cast("long").alias("length"))
    wrong = F.raise_error(F.concat(F.lit(f"a length is not from 1 to {capacity}: "), F.coalesce(F.col("length").cast("string"), F.lit("null"))))
    narrow = narrow.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(wrong.cast("long")))
    rows = written(narrow, "pieces")
    full = rows.filter(F.col("length") == capacity)
    done = [full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, before, turn = rows.filter(F.col("length") < capacity), 0, 0
    schema = rows_of.schema(pieces, keep, "length long, group long, bin long, offset long, loose boolean")
    while True:
        groups = -(-rest.count() // group_rows)
        last = groups <= 1 or (before and groups > before // 2)
        # a row's number depends on the written files only, so a task that runs again deals alike
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(max(1, groups))))
        packed = written(dealt.groupBy("group").applyInArrow(_pack_group(capacity), schema), f"packed{turn}")
        number = F.shiftleft(F.lit(turn).cast("long"), 58) + F.shiftleft(F.col("group"), 20) + F.col("bin")
        settled = packed if last else packed.filter(~F.col("loose"))
        done.append(settled.select(*names, number.alias("sequence_id"), "offset"))
        if last:
            break
        rest, before, turn = packed.filter("loose").select(*names, "length"), groups, turn + 1
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out.toDF(*keep, "sequence_id", "offset")


def cut(encoded: DataFrame, keep: Sequence[str], capacity: int = CAPACITY) -> DataFrame:
    """Rows with ``ids`` and ``n_tokens`` cut into pieces of at most ``capacity`` ids: the columns named
    in ``keep``, then piece (int from 0), start (long), length (long) and ids (binary). A row without
    ids gives none."""
    numbered = encoded.filter(F.col("n_tokens") > 0).select(*(f"`{c}`" for c in keep), "n_tokens", "ids", F.explode(F.expr(f"sequence(0, cast((n_tokens - 1) div {capacity} as int))")).alias("piece"))
    start = (F.col("piece") * capacity).cast("long")
    return numbered.select(*(f"`{c}`" for c in keep), "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("long").alias("length"), F.expr(f"substring(ids, piece * {4 * capacity} + 1, {4 * capacity})").alias("ids"))
