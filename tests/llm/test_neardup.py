"""Order MinHash near duplicates against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import neardup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=20), st.lists(st.integers(0, 8), max_size=20))
def test_alignment_is_the_longest_common_subsequence(a, b):
    assert neardup.aligned(np.array(a, np.uint32), np.array(b, np.uint32), 40) == lcs(a, b)


def test_band_limits_gaps():
    a = np.arange(20, dtype=np.uint32)
    assert neardup.aligned(a, np.roll(a, 10), 2) < 10 <= neardup.aligned(a, np.roll(a, 10), 20)


def test_sketches_depend_on_order():
    h = neardup.mix(np.arange(1, 200, dtype=np.uint64))
    same = neardup.order_sketches(h) == neardup.order_sketches(h)
    turned = neardup.order_sketches(h) == neardup.order_sketches(h[::-1].copy())
    assert same.all() and turned.mean() < 0.3


def brute(rows):
    """Least id of each row's class, by all pairs."""
    fold = [[w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()] for _, t in rows]
    labelled = []
    for w in fold:
        seen, out = {}, []
        for p in range(len(w) - 4):
            g = tuple(w[p : p + 5])
            out.append((g, seen.setdefault(g, 0)))
            seen[g] += 1
        labelled.append(out)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            equal = rows[i][1] is not None and rows[j][1] is not None and (fold[i] == fold[j] if fold[i] or fold[j] else rows[i][1] == rows[j][1])
            both, once = labelled[i] and labelled[j] and lcs(labelled[i], labelled[j]), (set(g for g, _ in labelled[i]), set(g for g, _ in labelled[j]))
            near = both and 5 * both >= 4 * (len(labelled[i]) + len(labelled[j]) - both) and 5 * len(once[0] & once[1]) >= 4 * len(once[0] | once[1])
            if equal or near:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, (i, _) in enumerate(rows)}


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < share / 3 else [f"n{rng.randint(0, 9999)}"] if r < share * 2 / 3 else [w, f"m{rng.randint(0, 99)}"] if r < share else [w]
    return out


def classes_of(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return neardup.near_duplicates(frame, ["doc_id"], **more)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    originals = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    texts = [" ".join(rng.choice(originals) if rng.random() < 0.3 else edited(rng, rng.choice(originals), rng.choice([0.01, 0.03, 0.08, 0.2]))) for _ in range(90)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in classes_of(spark, rows).collect()}
    assert got == brute(rows)


def test_a_large_group_of_near_copies(spark):
    """More members than are compared pair by pair, around one original, some of them too far from it."""
    rng = random.Random(5)
    original = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, original, rng.choice([0.005, 0.02, 0.1, 0.3])))) for i in range(60)] + [(100 + i, " ".join(original)) for i in range(20)]
    expected = brute(rows)
    for dealt in ((neardup.OTHERS_DEALT, neardup.MEMBERS_DEALT), (600, 900)):
        got = {r["doc_id"]: r["class_id"] for r in classes_of(spark, rows, small=4, dealt=dealt).collect()}
        assert got == expected


def versions(head, own, families):
    """Two texts of each family: a head that all share, a word of the family, own words."""
    start = " ".join(f"h{k}" for k in range(head))
    return [(2 * i + j, f"{start} f{i}" + "".join(f" o{2 * i + j}x{k}" for k in range(own))) for i in range(families) for j in (0, 1)]


@pytest.mark.parametrize("head, own, families", [(44, 5, 120), (12, 1, 250)])
def test_pairs_in_a_large_group_that_no_leader_connects(spark, head, own, families):
    """40 of 46 shingles (8 of 10) in common with all, 41 (9) with one: every pair is a class."""
    rows = versions(head, own, families)
    got = {r["doc_id"]: r["class_id"] for r in classes_of(spark, rows).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_short_texts_always_share_a_key():
    """4 and 5 shingles with 4 in common, and 10 and 10 with 9."""
    rng = np.random.default_rng(3)
    for a, b, both in [(4, 5, 4), (10, 10, 9), (30, 30, 27), (24, 30, 24)]:
        for _ in range(2_000):
            h = rng.integers(0, 2**63, a + b - both).astype(np.uint64)
            assert np.isin(neardup.short_keys(h[:a]), neardup.short_keys(h[a - both :])).any()


def test_prefix_holds_a_shingle_of_every_near_text():
    for n in range(1, 60):
        for m in range(1, n + 1):
            need = -(-4 * (n + m) // 9)
            if need <= m:
                assert neardup.prefix(n) > n - need and neardup.prefix(m) > m - need


def thue_morse(n):
    """Two words of n letters that every polynomial of their bytes modulo 2**64 takes for one."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_built_against_polynomial_hashes_differ(spark):
    one, two = thue_morse(2048)
    rows = [(0, one), (1, two), (2, " ".join([one] * 6)), (3, " ".join([two] * 6)), (4, " ".join([one] * 6))]
    assert {r["doc_id"]: r["class_id"] for r in classes_of(spark, rows).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}


def test_two_cuts_of_the_input_give_equal_classes(spark):
    rng = random.Random(11)
    original = [f"w{rng.randint(0, 90)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, original, rng.choice([0.01, 0.04, 0.07])))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(f, ["doc_id"]).collect()} for f in (frame.repartition(7, "doc_id"), frame.orderBy(F.desc("doc_id")).coalesce(1))]
    assert got[0] == got[1] and len(set(got[0].values())) > 1


def test_edges(spark):
    long = " ".join(f"w{k % 5000}" for k in range(30_000))
    rows = [(5, None), (4, None), (3, ""), (2, ""), (9, " \n"), (8, "one two"), (7, "One, two!"), (6, "one three"), (None, "null id of a text"), (1, "null id of a text"), (11, long), (10, long + " tail"), (12, "!!!"), (13, "???")]
    got = sorted(((r["doc_id"], r["class_id"], r["stays"]) for r in classes_of(spark, rows).collect()), key=str)
    of = {d: c for d, c, _ in got}
    assert of == {5: 5, 4: 4, 3: 2, 2: 2, 9: 9, 8: 7, 7: 7, 6: 6, None: 1, 1: 1, 11: 10, 10: 10, 12: 12, 13: 13}
    assert sorted(d for d, _, stays in got if stays) == [1, 2, 4, 5, 6, 7, 9, 10, 12, 13]


def test_repeated_rows_extra_columns_and_empty(spark):
    text = "a b c d e f g h"
    frame = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (1, text, "y")], "doc_id long, text string, row string")
    got = neardup.near_duplicates(frame, ["doc_id", "row"]).collect()
    assert len(got) == 3 and sum(r["stays"] for r in got) == 1 and {r["class_id"] for r in got} == {1}
    assert classes_of(spark, []).count() == 0


def test_classes_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["class"] for r in neardup.classes(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


#: Two words of equal 64-bit hash.
ALIKE = ("abbaabbabbbaaabaabaaabaaaaabaaaabbaaabaabbaabaabbbaaaaaa", "aaaabaaaaaaabaabbabbbababbbababaaaaababbaabbabbaaaabbabb")


def test_words_decide_not_hashes(spark):
    hashes = neardup.split(np.frombuffer(" ".join(ALIKE).encode(), np.uint8), np.array([0, 113]), neardup.ALNUM, neardup.FOLD).hash
    assert hashes[0] == hashes[1]
    plain = [f"w{i}" for i in range(60)]
    one, other = (" ".join(w if i % 5 else word for i, w in enumerate(plain)) for word in ALIKE)
    assert not neardup.words_near(one.encode(), other.encode())
    rows = [(1, one), (2, other), (3, other + " more")]
    for small in (16, 1):  # all pairs, and with leaders and cells
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], small=small).collect()
        assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(1, 1), (2, 2), (3, 2)]


@settings(max_examples=300, deadline=None)
@given(*[st.lists(st.sampled_from("abC"), max_size=30)] * 2)
def test_numbers_say_what_hashes_say(a, b):
    """Of short words no two hashes are equal, so both ways must agree."""
    texts = [" ".join(x) for x in (a, b)]
    held = neardup._each(neardup.pa.array(texts))
    left, right = neardup._numbered(*(t.encode() for t in texts))
    assert (left[:, None] == right).tolist() == (held[0][:, None] == held[1]).tolist()
    assert [(left & 1).tolist(), (right & 1).tolist()] == [(h & 1).tolist() for h in held]
    assert neardup.words_near(*(t.encode() for t in texts)) == neardup.is_near(*held)
