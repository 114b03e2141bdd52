"""Near duplicates by Order MinHash: sketches that keep the order of sampled shingles, links checked by
banded alignment, classes by contraction.

Shingles are five words (lower-cased runs of ASCII letters, digits and non-ASCII characters), and each
carries the number of its earlier occurrences in the text. A sketch takes the SAMPLED labelled shingles
of least hash and keeps their order in the text; SKETCHES such sketches are taken, each with its own
hash. Two texts whose aligned shingles are a share J of all theirs agree in one sketch with probability
about J ** SAMPLED (less in short texts, as shingles are drawn without replacement). Texts of at most
SHORT shingles are also keyed by their PREFIX, of which two near ones always share one; a longer pair
at J = 0.8 fails in all SKETCHES 3 to 5 times in 100,000.

Rows of equal words (equal 128-bit BLAKE2 digests of them) are one node. All nodes that share a key are
compared, unless they are known to be of one class:

1. in a group of at most SMALL nodes, all pairs; in a larger one each with the group's most central
   node, the one that meets most others in all its groups. A large group of copies comes together here
   at the cost of one comparison a member;
2. in the large groups that still hold several classes, every member outside the largest class with
   every member of another class. Both sides are dealt to tasks by their size, so neither a group nor
   a class has to fit anywhere, and no pair is ever a row: a task finds those that share a shingle of
   both prefixes (the rarest ones, of which two near texts share one), counts what they share and
   aligns what can be near. A pair that shares several keys is compared in the first one only.

Hashes of shingles leave pairs out; a pair that they find near is aligned once more on numbers that
stand for its words themselves, and linked only if it is near by these too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.rows import passing, schema
from tarn.llm.words import ALNUM, FOLD, Words, grams, mix, runs, split, whole
from tarn.shared import discard, written

SHINGLE = 5
SKETCHES = 20
SAMPLED = 4
SMALL = 16
#: Similarity as a fraction: at least 4 of 5.
NEAR = (4, 5)
#: Texts of at most so many shingles need no luck: no text of up to 24 is near one of over 30.
SHORT = 30
#: Shingles of the members outside the largest class, and of all members, that meet in one task.
OTHERS_DEALT = 500_000
MEMBERS_DEALT = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).reshape(2, -1)
_MULTIPLY, _SHIFT = _SEEDS[0] | np.uint64(1), _SEEDS[1]
#: Hash values that are held at once for one text.
HELD = 4_000_000
#: Capitals to small letters, all that is no word to spaces.
_NORMAL = bytes(int(FOLD[b]) if ALNUM[FOLD[b]] else 0x20 for b in range(256))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(labelled hashes of the shingles in text order, offsets of each row's). Equal shingles of a row
    differ by the number of the occurrence; a hash is odd from the second one on."""
    at = whole(words, SHINGLE)
    h, row = grams(words.hash, SHINGLE)[at], words.row_of()[at]
    order = np.argsort(mix(h ^ (row.astype(np.uint64) + np.uint64(1)) * _ODD), kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    if same.any():
        first = np.flatnonzero(np.r_[True, ~same])
        earlier = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        label = np.zeros(len(h), np.uint64)
        label[order] = earlier
        return (mix(h + label * _ODD) & ~np.uint64(1)) | (label > 0), np.searchsorted(row, np.arange(len(words.rows)))
    return h & ~np.uint64(1), np.searchsorted(row, np.arange(len(words.rows)))


def order_sketches(h: np.ndarray) -> np.ndarray:
    """The sketches of one text with at least one shingle."""
    n, k = len(h), min(SAMPLED, len(h))
    out, step = np.zeros(SKETCHES, np.uint64), max(1, HELD // n)
    for s in range(0, SKETCHES, step):
        own = slice(s, min(s + step, SKETCHES))
        hashed = (h[None, :] ^ _SHIFT[own, None]) * _MULTIPLY[own, None]
        least = np.argpartition(hashed, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(hashed), 1))
        least.sort(axis=1)  # text order
        value = np.arange(own.start + 1, own.stop + 1, dtype=np.uint64)
        for j in range(k):
            value = value * _ODD + h[least[:, j]]
        out[s : s + step] = mix(value)
    return out


def prefix(n):
    """How many first shingles of a text of n (or of each of an array), in any order that all texts share, hold one of every near
    text's: two near texts have at least NEAR of the longer one in common."""
    return n - -(-NEAR[0] * n // NEAR[1]) + 1


def short_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a text of at most SHORT shingles: its prefix by value; none for a longer one."""
    return mix(np.sort(h)[: prefix(len(h))] + _ODD) if len(h) <= SHORT else np.zeros(0, np.uint64)


def aligned(a: np.ndarray, b: np.ndarray, most_gaps: int) -> int:
    """Length of the longest common subsequence of two sequences of hashes, within the band of places
    that differ by at most most_gaps: the longest increasing run of the places that match. Labelled
    shingles differ within a text, so it takes n log n steps."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    ahead = int(differ[0]) if len(differ) else short
    a, b = a[ahead:], b[ahead:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    behind = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - behind], b[: len(b) - behind]
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b), np.searchsorted(a[order], b, "right")
    times = high - low
    j = np.repeat(np.arange(len(b)), times)
    # of equal shingles the last comes first, so that no two of them follow each other in a run
    i = order[np.repeat(high, times) - 1 - (np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times))]
    i = i[np.abs(i - j) <= most_gaps]
    if (i[1:] > i[:-1]).all():
        return ahead + behind + len(i)
    ends: list[int] = []  # the least place that ends a run of each length
    for x in i.tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return ahead + behind + len(ends)


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the aligned shingles are NEAR of all shingles of both, and so are the shared ones of all
    different ones."""
    top, low = NEAR
    both = len(a) + len(b)
    need = -(-top * both // (low + top))  # the least that is NEAR of both less itself
    if min(len(a), len(b)) < need or not need:
        return False
    common = a[np.isin(a, b)]  # labelled shingles differ within a text
    once = [int((x & 1 == 0).sum()) for x in (a, b, common)]
    if len(common) < need or low * once[2] < top * (once[0] + once[1] - once[2]):
        return False
    return aligned(a, b, both - 2 * need) >= need


def _numbered(left: bytes, right: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The labelled shingles of two texts as numbers: equal ones for equal words and labels, and for no others."""
    known: dict[bytes, int] = {}
    code = [np.array([known.setdefault(w, len(known)) for w in text.translate(_NORMAL).split()], np.int64) for text in (left, right)]
    words = np.concatenate(code)
    number = words[: max(0, len(words) - SHINGLE + 1)]
    for k in range(1, SHINGLE):  # runs of k + 1 words are numbered by those of k and one word more
        number = np.unique(number * len(known) + words[k : k + len(number)], return_inverse=True)[1]
    sides = [number[: max(0, len(code[0]) - SHINGLE + 1)], number[len(code[0]) :]]
    earlier = []
    for own in sides:
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        at = np.zeros(len(own), np.int64)
        at[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        earlier.append(at)
    most = max(len(own) for own in sides) + 1
    a, b = (2 * (own * most + at) + (at > 0) for own, at in zip(sides, earlier))
    return a, b


def words_near(left: bytes, right: bytes) -> bool:
    """``is_near`` on the words of two texts instead of hashes of them."""
    return is_near(*_numbered(left, right))


_SKETCH = "n int, fa long, fb long, sketches array<long>"


def _print(text: bytes) -> bytes:
    """Digest of the words of a text, or of the bytes of one without words."""
    words = text.translate(_NORMAL).split()
    return blake2b(b" ".join(words) if words else text, digest_size=16, person=b"words" if words else b"bytes").digest()


def _sketch(columns: int, text_at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = batch.column(text_at).is_null()
            for i, j, data, offsets in runs(batch.column(text_at)):
                h, rows = shingles(split(data, offsets, ALNUM, FOLD))
                raw, ends = data.tobytes(), offsets.tolist()
                prints = np.frombuffer(b"".join(_print(raw[x:y]) for x, y in zip(ends[:-1], ends[1:])), "<i8").reshape(-1, 2)
                missing = empty.slice(i, j - i).to_numpy(zero_copy_only=False)
                each = [h[x:y] for x, y in zip(rows[:-1], rows[1:])]
                sketches = [np.concatenate([order_sketches(own), short_keys(own)]).astype(np.int64) if len(own) else np.zeros(0, np.int64) for own in each]
                cut = batch.slice(i, j - i)
                arrays = [*cut.columns, pa.array(np.diff(rows), pa.int32()), *(pa.array(prints[:, k], pa.int64(), mask=missing) for k in range(2)), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*(f"k{c}" for c in range(columns)), "n", "fa", "fb", "sketches"])

    return work


def _each(texts: pa.Array) -> list[np.ndarray]:
    """The labelled shingles of every text."""
    out = []
    for _, _, data, offsets in runs(texts):
        h, rows = shingles(split(data, offsets, ALNUM, FOLD))
        out += [h[x:y] for x, y in zip(rows[:-1], rows[1:])]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, left, right) of nodes and their texts to the pairs (a, b) that are near."""
    for batch in batches:
        node = np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()])
        _, first, at = np.unique(node, return_index=True, return_inverse=True)
        n, held = len(batch), _each(pa.concat_arrays([batch.column("left"), batch.column("right")]).take(pa.array(first)))
        near = [is_near(held[i], held[j]) for i, j in zip(at[:n].tolist(), at[n:].tolist())]
        texts = batch.column("left"), batch.column("right")
        near = [yes and words_near(*(side[k].as_buffer().to_pybytes() for side in texts)) for k, yes in enumerate(near)]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], ["a", "b"])


class _Postings:
    """Which rows hold each token."""

    def __init__(self, token: np.ndarray, row: np.ndarray, tokens: int):
        order = np.argsort(token, kind="stable")
        self.row = row[order]
        self.start = np.searchsorted(token[order], np.arange(tokens + 1))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Rows that hold any of the tokens, as often as they do."""
        low, n = self.start[tokens], self.start[tokens + 1] - self.start[tokens]
        return self.row[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]


def _compare(table: pa.Table) -> pa.Table:
    """One cell of a large group: rows that are ``other`` with rows that are ``member`` of another class,
    each linked once to each class it is near to."""
    node, of, outside = (table.column(c).to_numpy() for c in ("node", "class", "outside"))
    texts = table.column("text").combine_chunks()
    held = _each(texts)
    n = np.array([len(h) for h in held], np.int64)
    row = np.repeat(np.arange(len(held)), n)
    known, token = np.unique(np.concatenate(held), return_inverse=True)
    rarity = np.empty(len(known), np.int64)
    rarity[np.argsort(np.bincount(token), kind="stable")] = np.arange(len(known))
    token = rarity[token]  # numbered from the rarest on
    order = np.lexsort((token, row))
    token = token[order]
    start = np.cumsum(n) - n
    is_member = np.flatnonzero(table.column("member").to_numpy())
    first = np.arange(len(token)) - start[row] < prefix(n)[row]
    inside = np.zeros(len(held), bool)
    inside[is_member] = True
    early = _Postings(token[inside[row] & first], row[inside[row] & first], len(known))
    whole_texts = _Postings(token[inside[row]], row[inside[row]], len(known))
    sketches = np.array([x[:SKETCHES] for x in table.column("sketches").to_pylist()], np.int64)
    key = table.column("key")[0].as_py()
    earlier = np.flatnonzero((sketches == key).all(axis=0))
    sketches = sketches[:, : earlier[0] if len(earlier) else SKETCHES]
    up = {int(x): int(x) for x in of}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    top, low = NEAR
    a, b = [], []
    for i in np.flatnonzero(table.column("other").to_numpy()).tolist():
        own = token[start[i] : start[i] + n[i]]
        met = np.unique(early.of(own[: prefix(int(n[i]))]))
        met = met[(of[met] != of[i]) & (np.minimum(n[met], n[i]) * low >= np.maximum(n[met], n[i]) * top) & (~outside[met] | (node[met] > node[i]))]
        if not len(met):
            continue
        shared = np.bincount(whole_texts.of(own), minlength=len(held))[met]
        met = met[shared * (low + top) >= top * (n[met] + n[i])]
        met = met[~(sketches[met] == sketches[i]).any(axis=1)]
        for j in met.tolist():
            x, y = root(int(of[i])), root(int(of[j]))
            if x != y and is_near(held[i], held[j]) and words_near(*(texts[k].as_buffer().to_pybytes() for k in (i, j))):
                up[max(x, y)] = min(x, y)
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_NEAR_SIZE = f"least(a.n, b.n) * {NEAR[1]} >= greatest(a.n, b.n) * {NEAR[0]}"


def _live(members: DataFrame) -> DataFrame:
    """Members (key, node, n, class) of groups that hold more than one class, with the group's size."""
    groups = members.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high")
    return members.join(groups.select("key", "size"), "key")


def _all_pairs(live: DataFrame) -> DataFrame:
    pairs = live.alias("a").join(live.alias("b"), F.expr(f"a.key = b.key and a.node < b.node and a.class != b.class and {_NEAR_SIZE}"))
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _with(live: DataFrame, leaders: DataFrame) -> DataFrame:
    """Each member with its group's leader ``b``."""
    pairs = live.alias("a").join(leaders, "key").filter(f"a.node != b.node and a.class != b.class and {_NEAR_SIZE}")
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def _propose(live: DataFrame, small: int) -> DataFrame:
    """Pairs (a, b) of live members to compare: all in groups of at most ``small``, else each member with
    the group's most central node."""
    few, many = live.filter(F.col("size") <= small), live.filter(F.col("size") > small)
    central = many.join(many.groupBy("node").agg(F.sum("size").alias("met")), "node")
    leaders = central.groupBy("key").agg(F.max(F.struct("met", "node", "n", "class")).alias("b"))
    return _all_pairs(few).unionByName(_with(many, leaders)).distinct()


def _cells(members: DataFrame, others: int, all_members: int) -> DataFrame:
    """Members (key, node, n, class) of large groups that hold several classes, dealt to cells (key, o, m)
    in which every member outside the group's largest class meets every member, in some cell.

    ``others`` and ``all_members`` bound the shingles of either side of a cell, about."""
    by_class = members.groupBy("key", "class").agg(F.struct(F.count("*").alias("rows"), F.sum("n").alias("n"), "class").alias("size"))
    kinds = by_class.groupBy("key").agg(F.max("size").alias("top"), F.sum("size.n").alias("all"), F.count("*").alias("classes")).filter("classes > 1")
    kinds = kinds.select("key", F.col("top.class").alias("top"), F.expr(f"cast((all - top.n) div {others} as int)").alias("last_o"), F.expr(f"cast(all div {all_members} as int)").alias("last_m"))
    placed = members.join(kinds, "key").withColumns({"outside": F.expr("class != top"), "at_o": F.expr("cast(pmod(xxhash64(node), last_o + 1) as int)"), "at_m": F.expr("cast(pmod(xxhash64(node, 1), last_m + 1) as int)")})
    met = "array_union(if(outside, transform(sequence(0, last_m), i -> struct(at_o as o, i as m)), array()), transform(sequence(0, last_o), i -> struct(i as o, at_m as m)))"
    cells = placed.withColumn("cell", F.explode(F.expr(met)))
    return cells.select("key", "cell.o", "cell.m", "node", "class", "outside", F.expr("outside and cell.o = at_o").alias("other"), F.expr("cell.m = at_m").alias("member"))


def _linked(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are near, by their texts (node, text)."""
    sides = (content.select(F.col("node").alias(n), F.col("text").alias(side)) for n, side in (("a", "left"), ("b", "right")))
    joined = pairs.join(next(sides), "a").join(next(sides), "b")
    return written(joined.mapInArrow(_verify, "a long, b long"), "links")


def classes(links: DataFrame) -> DataFrame:
    """(node, class) for every node of the links (a, b): class is the least node it is linked to over
    any number of links.

    Each turn every class takes the least neighbour as parent, paths are halved until they end, and
    the links are rewritten between classes. Each table is written, so lineage stays short."""
    label, left = None, written(links.filter("a != b").distinct(), "edges")
    while not left.isEmpty():
        ways = left.union(left.select("b", "a"))
        parent = written(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        while True:
            up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(parent.join(up, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jumps")
            parent = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        if label is None:
            label = parent.withColumnRenamed("up", "class")
        else:
            label = written(label.join(parent.withColumnRenamed("node", "class"), "class", "left").select("node", F.coalesce("up", "class").alias("class")), "labels")
        one = left.join(parent.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        left = written(one.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return label if label is not None else links.select(F.col("a").alias("node"), F.col("a").alias("class")).limit(0)


def near_duplicates(documents: DataFrame, keep: Sequence[str], text: str = "text", order: str = "doc_id", small: int = SMALL, dealt: tuple[int, int] = (OTHERS_DEALT, MEMBERS_DEALT)) -> DataFrame:
    """Give every document the class of its near duplicates.

    Returns a row for each row: the columns named in ``keep``, then ``class_id`` (the least ``order``
    of the class, nulls last) and ``stays`` (true for one row of each class: the one of least order,
    of equal ones any). Two texts are linked if their aligned five-word shingles are at least 0.8 of
    all their shingles, and the shared ones 0.8 of all different ones; classes are closed over links.
    Texts of equal words are one class, so are equal texts without words; a null text is a class of its
    own; texts of one to four words are only ever equal. ``keep`` may not hold the two new names; other
    columns are not read.
    """
    names = [f"k{i}" for i in range(len(keep))]
    columns = list(dict.fromkeys([*keep, order, text]))  # each travels once
    at = {c: f"k{i}" for i, c in enumerate(columns)}
    narrow = documents.withColumn(text, F.col(f"`{text}`").cast("string"))
    sketched = narrow.select(*passing(columns)).mapInArrow(_sketch(len(columns), columns.index(text)), schema(narrow, columns, _SKETCH))
    sketched = sketched.withColumn("order", F.col(at[order]))
    # a null text is a node of its own
    rows = written(sketched.withColumn("row", F.monotonically_increasing_id()).withColumn("fa", F.coalesce("fa", "row")), "sketched")
    first = written(rows.groupBy("fa", "fb").agg(F.min("row").alias("node")), "nodes")
    node_of = written(_nodes(rows, first), "node_of")
    alone = rows.join(node_of.filter("row = node").select("row"), "row", "left_semi")
    keys = alone.filter("n > 0").select(F.col("row").alias("node"), "n", F.explode("sketches").alias("key"))
    live = written(_live(keys.withColumn("class", F.col("node"))), "live")
    # whole texts are shuffled here only, and by the same plan for few nodes and for many
    texts = rows.select(F.col("row").alias("node"), F.col(at[text]).alias("text"), "sketches").hint("merge").join(live.select("node").distinct(), "node", "left_semi")
    content = written(texts, "content")
    links = _linked(_propose(live, small), content)
    label = classes(links)
    # large groups that still hold several classes
    large = live.filter(F.col("size") > small).select("key", "node", "n")
    if not large.isEmpty():
        of_node = large.select("node").distinct().join(label, "node", "left").select("node", F.coalesce("class", "node").alias("class"))
        cells = _cells(large.join(of_node, "node"), *dealt)
        more = written(cells.join(content, "node").groupBy("key", "o", "m").applyInArrow(_compare, "a long, b long").distinct(), "more_links")
        label = classes(links.unionByName(more))
    of_row = node_of.join(label, "node", "left").select("row", F.coalesce("class", "node").alias("class"))
    of_row = written(of_row, "classes")
    ranked = F.struct(F.col("order").isNull().alias("last"), "order", "row")
    least = of_row.join(rows.select("row", "order"), "row").groupBy("class").agg(F.min(ranked).alias("least"))
    named = written(of_row.join(least.select("class", F.col("least.order").alias("class_id"), F.col("least.row").alias("stayer")), "class").select("row", "class_id", (F.col("row") == F.col("stayer")).alias("stays")), "named")
    discard(first, node_of, live, content, links, of_row)
    # kept columns can be as large as the texts: like above, the same plan at every size
    return rows.hint("merge").join(named, "row").select(*names, "class_id", "stays").toDF(*keep, "class_id", "stays")


def _nodes(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(row, node). A second print that is null belongs to a null text, alone by its first."""
    return rows.select("row", "fa", "fb").join(first.withColumnsRenamed({"fa": "a", "fb": "b"}), F.expr("fa = a and fb <=> b")).select("row", "node")
