"""Substring dedup: repeated passages, confirmed word for word and located by Aho-Corasick automata.

A window is ``n`` consecutive words of one document. A word goes if a window over it also starts in a
document with a smaller id. Rows are dealt over parts of about ``part_bytes`` of text, and the work is
done part by part and shard by shard:

1. Candidates. Equal windows hold the same anchor: the least hash of their ANCHOR-word grams. Anchors
   are a fraction of all windows, and one that stands in a single document ends here. Each task counts
   its own anchors first, so a passage that everyone repeats is sent once a task. Then each part sends
   a short hash of every window on a recurring anchor, and learns which other parts hold too. Hashes
   only ever leave windows out; windows that differ are never taken for equal by them.
2. Confirmed passages. Each part sends the words of its runs of candidate windows, cut where the anchor
   changes, so that equal windows meet in one shard. The shard compares them word for word and finds
   the first document of each. Passages go back to the parts in which a later document holds them.
3. Location. Each part compiles the passages it was sent into Aho-Corasick automata, in shards of
   bounded size, with one character for each word, and streams through them all stretches of its
   documents whose pairs of neighbouring words stand in passages too. What they find in a later document
   than the passage's first one goes.

What travels is packed by pair of part and shard, documents compressed together by part. No step sees
more than a part or a shard. Shards stay the same size as the corpus grows; parts grow from PARTS of them
on, up to PART_GROWTH times, as what travels is as many messages as parts times shards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.rows import passing, schema
from tarn.llm.words import Words, covered, grams, mix, ranges, row_sums, runs, split, utf8, whole
from tarn.shared import discard, written

WINDOW = 13
ANCHOR = 7
PART_BYTES = 2 << 20
PARTS, PART_GROWTH = 512, 4
#: Bytes of text for each shard of the hash range, and for each shard in which words are compared.
SHARD_BYTES = 32 << 20
TEXT_SHARD_BYTES = 8 << 20
#: Anchors that a task holds before it sends them, and bytes of documents before it packs them.
HELD = 2_000_000
HELD_BYTES = 32 << 20
#: Words of the passages of one automaton.
AUTOMATON_WORDS = 400_000
#: Places of the table of pairs of neighbouring words in an automaton's passages.
PAIRS = 1 << 22
#: Windows of one piece of text that is sent to be compared.
SENT_WINDOWS = 64
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each with its own type, compressed."""
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unblob(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(sizes), 0, []
    for t, size in zip(types, sizes):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * size
    return out


def _by(key: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(key, rows of values with that key), in order of key."""
    order = np.argsort(key, kind="stable")
    key, values = key[order], [v[order] for v in values]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(key[a]), *(v[a:b] for v in values)


def _anchors(words: Words, n: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, its anchor): the shard, then 32 bits of the hash. Anchors are a filter:
    two that fall together by chance cost work, and no more of them do as the corpus grows, since a
    shard holds the same number."""
    starts = whole(words, n)
    k = min(ANCHOR, n)
    gram = grams(words.hash, k)
    if not len(starts):
        return starts, gram[:0]
    least = gram[starts]
    for j in range(1, n - k + 1):
        least = np.minimum(least, gram[starts + j])
    least = mix(least)
    return starts, (least % np.uint64(shards)) << np.uint64(32) | least >> np.uint64(32)


def _window_hashes(words: Words, starts: np.ndarray, n: int, shards: int) -> np.ndarray:
    """The shard of each window, then 32 bits of its hash: like anchors, a filter only."""
    h = np.zeros(len(starts), np.uint64)
    for j in range(n):
        h = h * _SECOND + words.hash[starts + j]
    h = mix(h)
    return (h % np.uint64(shards)) << np.uint64(32) | h >> np.uint64(32)


_SENT = "shard int, anchors binary, part int, found binary"


def _send_anchors(n: int, shards: int):
    """(part, text) batches to anchors for the shards of the hash range, and to parts those already
    seen in two documents of the task."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        anchor, part = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(anchor, kind="stable")
        anchor, part = anchor[order], part[order]
        first = np.r_[True, anchor[1:] != anchor[:-1]]
        size = np.diff(np.flatnonzero(np.r_[first, True]))
        often = np.repeat(size > 1, size)
        # to the shards: a lone anchor with its part, one seen twice without (its parts are told here)
        sent = [(s, _blob((a & _LOW).astype("<u4"), p.astype("<i4")), None, None) for s, a, p in _by((anchor[first] >> np.uint64(32)).astype(np.int32), anchor[first], np.where(often, -1, part)[first])]
        sent += [(None, None, p, _blob(np.unique(a))) for p, a in _by(part[often], anchor[often])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*sent), (pa.int32(), pa.binary(), pa.int32(), pa.binary()))], ["shard", "anchors", "part", "found"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for i, j, data, offsets in runs(batch.column(1)):
                words = split(data, offsets)
                starts, anchor = _anchors(words, n, shards)
                row = words.row_of()[starts]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])][: len(row)]
                row, anchor = row[new], anchor[new]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])][: len(row)]
                if new.any():
                    held.append((anchor[new], parts[i:j][row[new]]))
                    count += int(new.sum())
                if count > HELD:
                    yield from flush(held)
                    held, count = [], 0
        if held:
            yield from flush(held)

    return work


def _meet_anchors(table: pa.Table) -> pa.Table:
    """A shard's anchors: those sent twice or more go back to the parts that hold them."""
    held = [_unblob(x.as_py(), "<u4", "<i4") for x in table.column("anchors")]
    anchor, part = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(anchor, kind="stable")
    anchor, part = anchor[order], part[order]
    same = anchor[1:] == anchor[:-1]
    back = (np.r_[False, same] | np.r_[same, False])[: len(anchor)] & (part >= 0)
    shard = np.uint64(table.column("shard")[0].as_py()) << np.uint64(32)
    out = [(p, _blob(a.astype(np.uint64) | shard)) for p, a in _by(part[back], anchor[back])]
    return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "found": pa.array([f for _, f in out], pa.binary())})


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (part, ...) packed by part."""

    def flush(held: list) -> pa.RecordBatch:
        # taken once, from one chunk: taking rows of several chunks copies all of these each time
        rows = pa.Table.from_batches(held).combine_chunks()
        part = rows.column(0).to_numpy()
        order = np.argsort(part, kind="stable")
        rows, out = rows.take(order), []
        for p, at in _by(part[order], np.arange(len(rows))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows.slice(at[0], len(at)))
            out.append((p, sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in out], pa.int32()), "rows": pa.array([r for _, r in out], pa.binary())})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > HELD_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


_CANDIDATES = "shard int, part int, windows binary, runs array<string>, docs array<long>"


def _send_windows(n: int, shards: int):
    """A part's documents and recurring anchors to a row (shard, part, windows) for each shard that its
    windows fall in, and one row (part, runs, docs): the runs of these windows as text, and the document
    of each."""

    def work(packed: pa.Table, side: pa.Table) -> pa.Table:
        out = {name: [] for name in ("shard", "part", "windows", "runs", "docs")}

        def row(**values) -> None:
            for name, held in out.items():
                held.append(values.get(name))

        anchors = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_unblob(x, "<u8")[0] for x in side.column("found").to_pylist())]))
        if len(packed) and len(anchors):
            number = packed.column("part")[0].as_py()
            rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed.column("rows")]).combine_chunks()
            ids = rows.column("doc").combine_chunks().to_numpy()
            hashes, texts, docs = [np.zeros(0, np.uint64)], [], []
            for i, j, data, offsets in runs(rows.column("text").combine_chunks()):
                words = split(data, offsets)
                starts, anchor = _anchors(words, n, shards)
                starts = starts[np.isin(anchor, anchors)]
                hashes.append(_window_hashes(words, starts, n, shards))
                first, last = _runs(starts, words.row_of()[starts])
                texts.append(words.spans(first, last + n))
                docs.append(ids[i:j][words.row_of()[first]])
            different = np.unique(np.concatenate(hashes))
            for shard, x in _by((different >> np.uint64(32)).astype(np.int32), different):
                row(shard=shard, part=number, windows=_blob((x & _LOW).astype("<u4")))
            row(part=number, runs=pa.concat_arrays(texts).to_pylist(), docs=np.concatenate(docs))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.table({name: pa.array(held, kind) for (name, held), kind in zip(out.items(), kinds)})

    return work


def _meet_windows(table: pa.Table) -> pa.Table:
    """A shard's windows: each part learns, in the order it sent them, which stand in another part."""
    held = [_unblob(x.as_py(), "<u4")[0] for x in table.column("windows")]
    every = np.concatenate(held)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    shared = np.zeros(len(every), bool)
    shared[order] = np.r_[same, False] | np.r_[False, same]
    ends = np.cumsum([len(x) for x in held])
    bits = [np.packbits(shared[e - len(x) : e]).tobytes() for e, x in zip(ends, held)]
    return pa.table({"part": table.column("part"), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary())})


def _runs(starts: np.ndarray, row: np.ndarray, *cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window of each run of consecutive windows of one row; ``cut`` holds values that must
    not change within a run."""
    if not len(starts):
        return starts, starts
    new = np.r_[True, (np.diff(starts) > 1) | (row[1:] != row[:-1])]
    for values in cut:
        new[1:] |= values[1:] != values[:-1]
    return starts[new], starts[np.r_[new[1:], True]]


_SEGMENTS = "shard int, part int, segments array<string>, low array<long>, high array<long>, places array<long>"


def _send_segments(n: int, shards: int, text_shards: int):
    """A part's runs and the bits about their windows to the runs that recur, cut where the anchor changes,
    for the shards in which words are compared: their text, the first and the last document of the part
    that hold them, and, if they stand in one place of the part only, the number of their first window."""

    def work(held: pa.Table, side: pa.Table) -> pa.Table:
        out = {name: [] for name in ("shard", "part", "segments", "low", "high", "places")}
        if len(held):
            texts, docs = held.column("runs")[0].values, held.column("docs")[0].values.to_numpy()
            split_runs = [(i, j, split(data, offsets)) for i, j, data, offsets in runs(texts)]
            starts = [whole(words, n) for _, _, words in split_runs]
            window = np.concatenate([_window_hashes(words, at, n, shards) for (_, _, words), at in zip(split_runs, starts)])
            doc = np.concatenate([docs[i:j][words.row_of()[at]] for (i, j, words), at in zip(split_runs, starts)])
            different, which = np.unique(window, return_inverse=True)
            of, recurs = (different >> np.uint64(32)).astype(np.int32), np.zeros(len(different), bool)
            for shard, bits in zip(side.column("shard").to_pylist(), side.column("bits").to_pylist()):
                a, b = np.searchsorted(of, (shard, shard + 1))
                recurs[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            low, high = np.full(len(different), np.iinfo(np.int64).max), np.full(len(different), np.iinfo(np.int64).min)
            np.minimum.at(low, which, doc)
            np.maximum.at(high, which, doc)
            keep, used = (recurs | (low < high))[which], 0
            segments, doc, shard, place = [], [], [], []
            for (i, j, words), at in zip(split_runs, starts):
                mine = keep[used : used + len(at)]
                anchor = _anchors(words, n, text_shards)[1][mine]
                first, last = _runs(at[mine], words.row_of()[at[mine]], anchor)
                # texts that repeat themselves keep one anchor for long
                cut, piece = ranges(np.zeros(len(first), np.int64), (last - first) // SENT_WINDOWS + 1)
                first, last = first[piece] + cut * SENT_WINDOWS, np.minimum(last[piece], first[piece] + (cut + 1) * SENT_WINDOWS - 1)
                segments.append(words.spans(first, last + n))
                doc.append(docs[i:j][words.row_of()[first]])
                shard.append((anchor[np.searchsorted(at[mine], first)] >> np.uint64(32)).astype(np.int32))
                # a number is left out between runs, so that none seems to go on with the next one
                place.append(np.searchsorted(at, first) + used + i + words.row_of()[first])
                used += len(at)
            coded = pa.concat_arrays(segments).dictionary_encode()
            code, doc, shard, place = coded.indices.to_numpy(), np.concatenate(doc), np.concatenate(shard), np.concatenate(place)
            order = np.argsort(code, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])[: len(order)]
            low, high = (f.reduceat(doc[order], begin) if len(begin) else doc for f in (np.minimum, np.maximum))
            place = np.where(np.diff(np.r_[begin, len(order)]) == 1, place[order][begin], -1)
            for s, at in _by(shard[order][begin], np.arange(len(begin))):
                for name, value in zip(out, (s, held.column("part")[0].as_py(), coded.dictionary.take(pa.array(at)), low[at], high[at], place[at])):
                    out[name].append(value)
        lists = [pa.array(out["shard"], pa.int32()), pa.array(out["part"], pa.int32()), _lists(out["segments"], pa.string()), *(_lists(out[x], pa.int64()) for x in ("low", "high", "places"))]
        return pa.table(lists, list(out))

    return work


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    """A list array of arrays."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    flat = pa.concat_arrays([pa.array([], kind), *(x if isinstance(x, pa.Array) else pa.array(x, kind) for x in values)])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _window_numbers(code: np.ndarray, n: int) -> np.ndarray:
    """Equal numbers for equal runs of n codes, from each place on, and for no others: pairs of numbers
    are numbered anew, over twice as many codes each time."""
    if len(code) < n:
        return np.zeros(0, np.int64)
    known, size, out, done = code.astype(np.int64), 1, None, 0
    while True:
        if n & size:  # so many codes more
            out = known if out is None else np.unique(out[: len(known) - done] * (known.max() + 1) + known[done:], return_inverse=True)[1]
            done += size
        if 2 * size > n:
            return out
        known = np.unique(known[:-size] * (known.max() + 1) + known[size:], return_inverse=True)[1]
        size *= 2


_PASSAGES = "part int, passages array<string>, first array<long>, places array<long>"


def _confirm(n: int):
    """A shard's segments to the passages in them whose windows have one first document each, with that
    document, for each part that has a later one; places are numbers of windows as above."""

    def work(table: pa.Table) -> pa.Table:
        lists = {name: [x.values for x in table.column(name)] for name in ("segments", "low", "high", "places")}
        coded = pa.concat_arrays(lists["segments"]).dictionary_encode()
        which = coded.indices.to_numpy()
        part = np.repeat(table.column("part").to_numpy(), [len(x) for x in lists["segments"]])
        low, high, place = (np.concatenate([x.to_numpy() for x in lists[name]]) for name in ("low", "high", "places"))
        least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least, which, low)
        words = split(*utf8(coded.dictionary), hashed=False)
        starts = whole(words, n)
        number = _window_numbers(words.texts().dictionary_encode().indices.to_numpy(), n)[starts]
        row = words.row_of()[starts]
        first = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, number, least[row])
        first = first[number]
        begin, end = _runs(starts, row, first)
        at = np.searchsorted(starts, begin)
        passages, first, row = words.spans(begin, end + n), first[at], row[at]
        # the passages of each segment that each part holds, where one of its documents is later
        passage, sent = ranges(np.searchsorted(row, which), np.searchsorted(row, which, "right"))
        later = first[passage] < high[sent]
        passage, sent = passage[later], sent[later]
        place = np.where(place[sent] >= 0, place[sent] + begin[passage] - words.rows[row[passage]], -1)
        out = list(_by(part[sent], passage, place))
        lists = [pa.array([p for p, _, _ in out], pa.int32()), _lists([passages.take(pa.array(k)) for _, k, _ in out], pa.string()), _lists([first[k] for _, k, _ in out], pa.int64()), _lists([at for _, _, at in out], pa.int64())]
        return pa.table(lists, ["part", "passages", "first", "places"])

    return work


def _characters(codes: np.ndarray) -> str:
    """One character for each code from 0; surrogates are left out."""
    codes = codes + (codes >= 0xD800) * 0x800
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def _stitched(words: Words, first: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of words, rows, first document of each row): the passages as longer ones, where one goes on
    with the next window of the same place and has the same first document."""
    order = np.lexsort((place, place < 0))
    place, first, begin, end = place[order], first[order], words.rows[:-1][order], words.rows[1:][order]
    windows = end - begin - n + 1
    goes_on = np.r_[False, (place[:-1] >= 0) & (place[:-1] + windows[:-1] == place[1:]) & (first[:-1] == first[1:])][: len(place)]
    # so many words already stand at the end of the passage before
    which, piece = ranges(begin + np.where(goes_on, n - 1, 0), end)
    row = np.cumsum(~goes_on) - 1
    return which, np.searchsorted(row[piece], np.arange((row.max() + 1 if len(row) else 0) + 1)), first[~goes_on]


def _pairs(code: np.ndarray) -> np.ndarray:
    """The place of each pair of neighbouring words in a table of PAIRS, by their characters."""
    return (code[:-1] * 0x9E3779B1 + code[1:]) % PAIRS


def _automata(passages: pa.Array, first: np.ndarray, place: np.ndarray, n: int) -> Iterator[tuple]:
    """Automata over one character a word, each with its vocabulary (in order of character, from 1 on),
    and both (first document, words) of its passages and the table of the pairs in them."""
    import ahocorasick

    words = split(*utf8(passages), hashed=False)
    which, rows, first = _stitched(words, first, place, n)
    shard = (rows[1:] - 1) // AUTOMATON_WORDS
    texts = words.texts()
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        begin = int(rows[mine[0]])
        coded = texts.take(pa.array(which[begin : rows[mine[-1] + 1]])).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64) + 1
        text, paired = _characters(code), np.zeros(PAIRS, bool)
        paired[_pairs(code)] = True  # those over the end of a passage only let more through
        automaton, known = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for k in mine.tolist():
            key = text[rows[k] - begin : rows[k + 1] - begin]
            automaton.add_word(key, len(known))
            known.append((int(first[k]), len(key)))
        automaton.make_automaton()
        yield automaton, coded.dictionary, (known, paired)


def _locate(words: Words, doc: np.ndarray, known: np.ndarray, automata: list[tuple], n: int) -> np.ndarray:
    """Mask of the words that go: those in passages that the automata find in a row of a later document."""
    if not automata or not len(words.start):
        return np.zeros(len(words.start), bool)
    hits = [np.zeros((0, 2), np.int64)]
    texts, row = words.texts(), words.row_of()
    for automaton, vocabulary, (passages, paired) in automata:
        code = pc.fill_null(pc.index_in(texts, vocabulary), -1).to_numpy().astype(np.int64) + 1
        text, found = _characters(code), []
        # a passage lies in a stretch of one row in which each pair of neighbours stands in some passage; elsewhere
        # an automaton would search the many first words of passages for each word
        cut = np.flatnonzero(~paired[_pairs(code)] | (row[1:] != row[:-1])) + 1
        begin, end = np.r_[0, cut], np.r_[cut, len(code)]
        stretch = (end - begin >= n) & known[row[begin]]
        for a, b, own in zip(begin[stretch].tolist(), end[stretch].tolist(), doc[row[begin[stretch]]].tolist()):
            for last, k in automaton.iter(text, a, b):
                first, length = passages[k]
                if own > first:
                    found.append((last + 1 - length, last + 1))
        if found:
            hits.append(np.array(found, np.int64))
    begin, end = np.concatenate(hits).T
    return covered(begin, end, len(words.start))


def _remove(n: int, keep: int, text_at: int):
    names = [*(f"k{c}" for c in range(keep)), "n_words", "n_removed", "removed", "kept"]
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def work(packed: pa.Table, side: pa.Table) -> pa.Table:
        held = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed.column("rows")]).combine_chunks()
        known, ids = (x.combine_chunks() for x in (held.column("doc").is_valid(), held.column("doc").fill_null(0)))
        known, ids = known.to_numpy(zero_copy_only=False), ids.to_numpy()
        passages = [x.values for x in side.column("passages")]
        first, place = (np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in side.column(name))]) for name in ("first", "places"))
        automata = list(_automata(pa.concat_arrays(passages), first, place, n)) if passages else []
        out = []
        for i, j, data, offsets in runs(held.column("text").combine_chunks()):
            words = split(data, offsets, hashed=False)
            gone = _locate(words, ids[i:j], known[i:j], automata, n)
            row = words.row_of()
            parted = np.r_[row[1:] != row[:-1], True][: len(row)]
            edge = np.flatnonzero(gone & ~(np.r_[False, gone[:-1]][: len(gone)] & ~np.r_[True, parted[:-1]][: len(gone)]))
            stop = np.flatnonzero(gone & (np.r_[~gone[1:], True][: len(gone)] | parted)) + 1
            spans = [[] for _ in range(i, j)]
            for a, b in zip(edge.tolist(), stop.tolist()):
                spans[row[a]].append({"first": a - words.rows[row[a]], "last": b - words.rows[row[a]]})
            columns = [held.column("text" if c == text_at else f"k{c}").slice(i, j - i).combine_chunks() for c in range(keep)]
            left = np.flatnonzero(~gone)
            columns += [pa.array(words.count(), pa.int64()), pa.array(row_sums(gone, words.rows), pa.int64()), pa.array(spans, spans_type), words.joined(left, row[left], j - i)]
            out.append(pa.table(columns, names))
        return pa.concat_tables(out)

    return work


def remove_repeats(
    documents: DataFrame, keep: Sequence[str], text: str = "text", order: str = "doc_id", n: int = WINDOW, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, text_shard_bytes: int = TEXT_SHARD_BYTES,
) -> DataFrame:
    """Remove each word that a window covers whose word sequence also starts in a document with a
    smaller ``order`` (a whole number).

    Returns a row for each row: the columns named in ``keep``, then ``n_words`` and ``n_removed``
    (long), ``removed`` (array of ranges of word numbers) and ``kept`` (the words that stay, joined by
    one space). Words are runs of anything but ASCII white space, and compared as they are. Null and
    empty texts, and texts of fewer than ``n`` words, lose nothing. Of rows with equal ids neither is the
    smaller; a row with a null id loses nothing and takes nothing from others. Windows are judged on the
    input. ``keep`` may not hold the new names; other columns are not read. The table is read four times
    and its texts shuffled twice, compressed; a text that is also in ``keep`` travels once.
    """
    words = F.col(f"`{text}`").cast("string")
    size = documents.agg(F.sum(F.octet_length(words))).first()[0] or 0
    part_bytes = max(part_bytes, min(size // PARTS, PART_GROWTH * part_bytes))
    parts, shards, text_shards = (size // x + 1 for x in (part_bytes, shard_bytes, text_shard_bytes))
    doc = F.col(f"`{order}`").cast("long")
    # rows without an id only pass through, so they may be dealt anyhow
    part = F.pmod(F.when(doc.isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(doc, words)), F.lit(parts)).cast("int").alias("part")
    text_at = list(keep).index(text) if text in keep and dict(documents.dtypes)[text] == "string" else -1
    narrow = [part, doc.alias("doc"), words.alias("text")]
    others = [c for i, c in enumerate(passing(keep)) if i != text_at]
    known = documents.filter(doc.isNotNull())
    sent = written(known.select(part, words).mapInArrow(_send_anchors(n, shards), _SENT), "anchors")
    met = sent.filter(F.col("shard").isNotNull()).select("shard", "anchors").groupBy("shard").applyInArrow(_meet_anchors, "part int, found binary")
    found = written(met.unionByName(sent.filter(F.col("part").isNotNull()).select("part", "found")), "found")
    dealt = known.select(*narrow).mapInArrow(_deal, "part int, rows binary")
    candidates = written(dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_send_windows(n, shards), _CANDIDATES), "candidates")
    bits = candidates.filter(F.col("shard").isNotNull()).select("shard", "part", "windows").groupBy("shard").applyInArrow(_meet_windows, "part int, shard int, bits binary")
    held = candidates.filter(F.col("shard").isNull()).select("part", "runs", "docs")
    segments = held.groupBy("part").cogroup(bits.groupBy("part")).applyInArrow(_send_segments(n, shards, text_shards), _SEGMENTS)
    passages = written(segments.groupBy("shard").applyInArrow(_confirm(n), _PASSAGES), "passages")
    discard(sent, found, candidates)
    result = schema(documents, keep, "n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string")
    dealt = documents.select(*narrow, *others).mapInArrow(_deal, "part int, rows binary")
    return dealt.groupBy("part").cogroup(passages.groupBy("part")).applyInArrow(_remove(n, len(keep), text_at), result).toDF(*keep, "n_words", "n_removed", "removed", "kept")
