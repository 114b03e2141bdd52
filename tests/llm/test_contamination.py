"""Benchmark decontamination against brute force over all windows."""

import random
import re

import pytest

from tarn.llm.contamination import find_benchmark, is_contaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for p in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if got := windows.get(tuple(w[p : p + size])):
                    found |= got
                    hit |= set(range(p, p + size))
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w), sorted(hit)))
    return sorted(out, key=str)


def found(spark, rows, items, n, **more):
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = find_benchmark(docs, bench, ["doc_id"], n=n, **more).withColumn("contaminated", is_contaminated()).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"], [q for s in r["spans"] for q in range(s["first"], s["last"])]) for r in got), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [200_000, 7])
def test_equals_brute_force(spark, seed, block):
    rng = random.Random(seed)
    items = [(rng.choice([i, i, 3]), rng.choice([" ", "-", "\n"]).join(rng.choice("abcAé") for _ in range(rng.randint(0, 8)))) for i in range(9)]
    rows = [(i, rng.choice([" ", ", "]).join(rng.choice(["a", "b", "C", "É", "é", "x", "7"]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    assert found(spark, rows, items, 4, block_windows=block) == brute(rows, items, 4)


def test_edges(spark):
    items = [(1, "one two three"), (2, None), (None, "nine"), (3, "..."), (4, "one two three"), (5, "solo")]
    rows = [(1, "ONE two, three"), (1, "ONE two, three"), (None, "x solo"), (2, None), (3, ""), (4, "x " * 50_000 + "one two three"), (5, "one two")]
    got = found(spark, rows, items, 13)
    assert got == brute(rows, items, 13)
    assert found(spark, [], items, 13) == [] and len(found(spark, rows, [], 13)) == 7


def test_kept_columns_pass_through(spark):
    docs = spark.createDataFrame([("a", "solo", 1.5)], "k0 string, text string, items double")
    row = find_benchmark(docs, spark.createDataFrame([(1, "solo")], "item_id long, text string"), ["k0", "text"]).first()
    assert (row["k0"], row["text"], row["items"]) == ("a", "solo", ["1"])


@pytest.mark.parametrize("block", [200_000, 1])
def test_columns_of_any_name(spark, block):
    """Names with dots, and those that the operator once used itself, keep their values in every block."""
    docs = spark.createDataFrame([(77, "a", 5, "x solo", "one"), (77, "b", 6, "one two", "two"), (77, None, 7, None, None)], "`__row` int, `a.b` string, row int, `the.text` string, k0 string")
    bench = spark.createDataFrame([(1, "solo"), (2, "one two")], "`item.id` long, `item.text` string")
    got = find_benchmark(docs, bench, ["__row", "a.b", "row", "k0", "the.text"], text="the.text", item="item.id", item_text="item.text", block_windows=block)
    assert got.columns == ["__row", "a.b", "row", "k0", "the.text", "n_words", "n_hit", "spans", "items"]
    rows = sorted(tuple(r)[:7] + (r["items"],) for r in got.collect() if r["row"] < 7)
    assert rows == [(77, "a", 5, "one", "x solo", 2, 1, ["1"]), (77, "b", 6, "two", "one two", 2, 2, ["2"])]
    assert [tuple(r)[:7] for r in got.filter("row = 7").collect()] == [(77, None, 7, None, None, 0, 0)]
