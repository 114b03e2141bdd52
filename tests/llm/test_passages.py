"""Repeated passages against a brute force over all windows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import passages
from tarn.llm.passages import remove_repeats
from tarn.llm.words import split


def brute(rows, n):
    """(id, words, removed word numbers) of each row."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[p : p + n])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        gone = {q for p in range(len(w) - n + 1) if i is not None and first[tuple(w[p : p + n])] < i for q in range(p, p + n)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone), sorted(gone)))
    return sorted(out, key=str)


def found(spark, rows, n, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(frame, ["doc_id"], n=n, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], [q for s in r["removed"] for q in range(s["first"], s["last"])]) for r in got), key=str)


SMALL = {"part_bytes": 300, "shard_bytes": 200, "text_shard_bytes": 150}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("more", [{}, SMALL])
def test_equals_brute_force(spark, seed, more):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 20))] for _ in range(4)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.5 else [rng.choice(["x", "é", "w%d" % rng.randint(0, 9)]) for _ in range(rng.randint(1, 9))]
        rows.append((rng.choice([i, i, i, 3, None]), rng.choice([" ", "\n", "  \t"]).join(words)))
    assert found(spark, rows, 4, **more) == brute(rows, 4)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text("ab \n", max_size=25)), max_size=8))
def test_tiny_alphabet(spark, rows):
    assert found(spark, rows, 3, **SMALL) == brute(rows, 3)


def test_edges(spark):
    words = " ".join(f"w{k}" for k in range(13))
    rows = [(1, words), (2, words), (2, words), (3, None), (4, ""), (5, "w0 w1"), (None, words), (6, "a " * 50_000), (7, "a " * 20)]
    got = found(spark, rows, 13)
    assert got == brute(rows, 13)
    assert found(spark, [], 13) == []


def test_equal_numbers_for_equal_windows():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 12, 13):
        for length in (0, 1, 12, 13, 14, 60):
            codes = rng.integers(0, 3, length)
            windows = [tuple(codes[i : i + n]) for i in range(length - n + 1)]
            numbers = passages._window_numbers(codes, n).tolist()
            assert len(numbers) == len(windows) and len(set(zip(numbers, windows))) == len(set(windows)) == len(set(numbers))


def test_passages_in_several_automata(spark, monkeypatch):
    monkeypatch.setattr(passages, "AUTOMATON_WORDS", 200)
    text = [f"w{k % 977}" for k in range(3_000)]
    sent = pa.array([" ".join(text[k : k + 40]) for k in range(0, 2_988, 20)])
    automata = list(passages._automata(sent, np.ones(len(sent), np.int64), np.full(len(sent), -1), 13))
    assert len(automata) > 10
    data = " ".join(text).encode()
    words = split(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert passages._locate(words, np.array([2]), np.array([True]), automata, 13).all()
    assert not passages._locate(words, np.array([1]), np.array([True]), automata, 13).any()


def test_nothing_goes_without_automata(spark, monkeypatch):
    """All that goes is what automata find: with none, nothing does."""
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words), (2, "x " + words), (3, words + " y")]
    packed = pa.table({"part": pa.array([0], pa.int32()), "rows": [passages._deal(iter([pa.RecordBatch.from_pydict({"part": pa.array([0] * 3, pa.int32()), "doc": [r[0] for r in rows], "text": [r[1] for r in rows]})])).__next__().column("rows")[0].as_py()]})
    sent = pa.table({"passages": [[words]], "first": [[1]], "places": [[0]]})
    removed = lambda side: passages._remove(13, 0, -1)(packed, side).column("n_removed").to_pylist()
    assert removed(sent) == [0, 30, 30] and removed(sent.slice(0, 0)) == [0, 0, 0]


def test_words_built_against_polynomial_hashes_differ(spark):
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 20)), (2, " ".join([two] * 20)), (3, " ".join([one] * 13))]
    assert found(spark, rows, 13) == brute(rows, 13)


def test_words_decide_where_all_hashes_are_equal(spark, monkeypatch):
    """A shard compares words: segments that met by equal hashes and differ in one word share nothing."""
    segments = [[" ".join(f"w{k}" for k in range(13)), " ".join(f"w{k}" for k in range(12)) + " other"], [" ".join(f"w{k}" for k in range(13))]]
    got = passages._confirm(13)(pa.table({"shard": pa.array([0, 0], pa.int32()), "part": pa.array([1, 2], pa.int32()), "segments": segments, "low": [[5, 3], [7]], "high": [[5, 3], [9]], "places": [[0, 1], [40]]}))
    assert got.to_pylist() == [{"part": 2, "passages": [segments[0][0]], "first": [5], "places": [40]}]


def test_passages_are_stitched_where_they_go_on():
    texts = pa.array([" ".join(f"w{k}" for k in range(a, b)) for a, b in ((0, 15), (3, 16), (4, 18), (30, 43))])
    automata = lambda first, place: [key for a, vocabulary, _ in passages._automata(texts, np.array(first), np.array(place), 13) for key in ["".join(vocabulary[ord(c) - 1].as_py().decode() for c in k) for k in a.keys()]]
    text = lambda a, b: "".join(f"w{k}" for k in range(a, b))
    assert sorted(automata([1, 1, 1, 1], [100, 103, 104, 7])) == sorted([text(0, 18), text(30, 43)])
    assert sorted(automata([1, 2, 1, 1], [100, 103, 104, 7])) == sorted([text(0, 15), text(3, 16), text(4, 18), text(30, 43)])
    assert sorted(automata([1, 1, 1, 1], [100, -1, 104, 105])) == sorted([text(0, 15), text(3, 16), text(4, 18), text(30, 43)])


def test_dealing_costs_as_much_for_many_parts_as_its_rows():
    """Rows of a table in chunks were taken part by part, each time with a copy of all of its texts."""
    import time

    rng = np.random.default_rng(4)
    parts = rng.integers(0, 600, 4_000)
    texts = ["".join(map(chr, rng.integers(97, 123, 3_000))) for _ in range(40)]
    batches = [pa.RecordBatch.from_pydict({"part": pa.array(parts[k : k + 500], pa.int32()), "doc": np.arange(k, k + 500), "text": [texts[i % 40] for i in range(k, k + 500)]}) for k in range(0, 4_000, 500)]

    def seconds(own):
        start = time.perf_counter()
        dealt = list(passages._deal(iter(own)))
        return time.perf_counter() - start, dealt

    few = min(seconds([b.set_column(0, "part", pa.array(b.column(0).to_numpy() % 10)) for b in batches])[0] for _ in range(3))
    many, dealt = min((seconds(batches) for _ in range(3)), key=lambda x: x[0])
    assert many < 12 * few
    got = [(p, r["doc"], r["text"]) for b in dealt for p, rows in zip(b.column(0).to_pylist(), b.column(1)) for r in pa.ipc.open_stream(rows.as_buffer()).read_all().to_pylist()]
    assert sorted(got) == sorted((int(parts[i]), i, texts[i % 40]) for i in range(4_000))


def test_only_stretches_of_known_pairs_are_searched():
    """What is searched for passages is what may hold one, whatever the number of passages and the length of the text."""
    searched, passage = [], [f"p{k}" for k in range(20)]

    class Counting:
        def __init__(self, automaton):
            self.automaton = automaton

        def iter(self, text, a, b):
            searched.append(b - a)
            return self.automaton.iter(text, a, b)

    ((automaton, vocabulary, known),) = passages._automata(pa.array([" ".join(passage)]), np.array([1]), np.array([-1]), 13)
    text = [*(f"x{k}" for k in range(5_000)), *passage, *(f"p{k * 7 % 20}" for k in range(3_000)), *passage[:12]]
    data = " ".join(text).encode()
    words = split(np.frombuffer(data, np.uint8), np.array([0, len(data)]), hashed=False)
    gone = passages._locate(words, np.array([2]), np.array([True]), [(Counting(automaton), vocabulary, known)], 13)
    assert np.flatnonzero(gone).tolist() == list(range(5_000, 5_020)) and sum(searched) < 100


def test_parts_grow_before_their_messages_grow_with_the_square(spark, monkeypatch):
    monkeypatch.setattr(passages, "PARTS", 5)
    rows = [(i, " ".join(f"w{(i % 9) * 50 + k}" for k in range(40))) for i in range(60)]
    assert found(spark, rows, 13, **SMALL) == brute(rows, 13)
