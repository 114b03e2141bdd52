"""Mixing: targets against a loop, thresholds against sorted places, edges."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing

OF = "doc_id long, source string, text string"


def targets(sizes, weights, total, limit=3):
    """Targets in fractions, one source over its limit at a time."""
    left, open_, out = Fraction(total), set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if weight and limit * sizes[s] * weight < weights[s] * left]
        if not over:
            return out | {s: weights[s] * left / weight if weight else Fraction(0) for s in open_}
        out[over[0]] = Fraction(limit * sizes[over[0]])
        left -= out[over[0]]
        open_.remove(over[0])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_a_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"={i:02}": rng.choice([0, 1, 5, 40, 900, 10_000]) for i in range(12)}
    weights = {s: rng.choice([0, 1, 2, 5]) for s in sizes}
    total = rng.choice([None, 0, 100, 10**6])
    frame = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "of string, size long, weight long")
    got = {r["of"]: r["target"] for r in mixing.targets(frame, total).collect()}
    want = targets(sizes, weights, sum(sizes.values()) if total is None else total)
    assert got == pytest.approx({s: float(t) for s, t in want.items()}) and len(got) == len(sizes)


def taken(rows, budget):
    """Ids below the threshold: rows (place, id, size) in order of place, the last one if that is nearer."""
    out, total = set(), 0
    for _, i, size in sorted(rows):
        if total + size > budget:
            return out | {i} if total < budget and total + size - budget <= budget - total else out
        out.add(i)
        total += size
    return out


@pytest.mark.parametrize("digits", [1, 3])
def test_thresholds_against_sorted_places(spark, monkeypatch, digits):
    monkeypatch.setattr(mixing, "DIGITS", digits)
    rng = random.Random(digits)
    rows = [(rng.choice("ab"), i, rng.choice([0, 1, 2, 50]), f"{rng.randint(0, 300):015x}{i:016x}{i:016x}") for i in range(900)]
    budgets = [(s, k, float(b)) for s in "ab" for k, b in enumerate([0, 0.5, 1, 17.25, 1000, 4000.5, 10**9])]
    frame = spark.createDataFrame(rows, "of string, doc_id long, size long, place string").repartition(5)
    found = mixing.thresholds(frame, spark.createDataFrame(budgets, "of string, pass int, budget double")).collect()
    assert len(found) == len(budgets)
    bounds = {(r["of"], r["pass"]): r["bound"] for r in found}
    for s, k, budget in budgets:
        of = [(p, i, n) for o, i, n, p in rows if o == s and n]
        assert {i for p, i, n in of if p < bounds[s, k]} == taken(of, budget), (s, k)


def corpus(n=2_000):
    rng = random.Random(3)
    return [(i, rng.choice(["hot"] * 6 + ["b", "c", None, "é", "𝒳"]), " ".join(["w"] * rng.choice([0, 3, 10, 40]))) for i in range(n)]


def test_sums_come_near_their_targets_and_reruns_agree(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, OF)
    runs = [mixing.mix_sources(frame.repartition(n), ["doc_id", "source"]).collect() for n in (1, 7)]
    assert {(r["doc_id"], r["mix"]["taken"]) for r in runs[0]} == {(r["doc_id"], r["mix"]["taken"]) for r in runs[1]}
    sizes, sums, goal = Counter(), Counter(), {}
    for i, s, t in rows:
        sizes[s] += len(t.split())
    for r in runs[0]:
        sums[r["source"]] += r["mix"]["taken"]
        goal[r["source"]] = r["mix"]["target"]
        assert r["mix"]["taken"] == r["mix"]["copies"] * r["mix"]["size"] and r["mix"]["copies"] <= 3 and r["mix"]["source_size"] == sizes[r["source"]]
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    want = targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values()))
    assert goal == pytest.approx({s: float(t) for s, t in want.items()})
    assert all(abs(sums[s] - goal[s]) <= 40 for s in sizes)


def test_a_smaller_mix_lies_in_a_larger_one(spark):
    frame = spark.createDataFrame(corpus(400), OF)
    small, large = ({r["doc_id"]: r["mix"]["copies"] for r in mixing.mix_sources(frame, ["doc_id"], total=t).collect()} for t in (1_000, 4_000))
    assert all(small[i] <= large[i] for i in small) and sum(small.values()) < sum(large.values())


def test_a_table_of_weights_and_the_rows_of_the_mix(spark):
    frame = spark.createDataFrame([(i, "a" if i % 2 else None, "x y") for i in range(100)], OF)
    weights = spark.createDataFrame([("a", 3), ("gone", 5)], "source string, weight int")
    mixed = mixing.mix_sources(frame, ["doc_id", "source", "text"], weights)
    rows = mixing.repeated(mixed).collect()
    assert Counter(r["source"] for r in rows) == {"a": 100} and {r["copy"] for r in rows} == {0, 1}
    assert set(rows[0].asDict()) == {"doc_id", "source", "text", "copy"}


def test_nulls_ties_repeats_and_clashing_names(spark):
    """A third of the rows is one row without an id: a share of them is taken, not all or none."""
    rows = [(None, "a", "same words")] * 300 + [(7, "a", "x " * k) for k in range(1, 40)] + [(i, None, None) for i in range(5)] + [(1, "b", "w " * 100_000), (2, "b", "")]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], OF + ", size int, place string").repartition(4)
    got = mixing.mix_sources(frame, ["doc_id", "source", "size", "place"], total=100).collect()
    assert len(got) == len(rows) and {(r["size"], r["place"]) for r in got} == {(1, "p")}
    sums = defaultdict(int)
    for r in got:
        sums[r["source"]] += r["mix"]["taken"]
    assert abs(sums["a"] - 100 * 5 / 8 - 100 * 1 / 8 * 5 / 7) < 40 and sums[None] == 0
    again = mixing.mix_sources(frame.repartition(9), ["doc_id", "source"], total=100).collect()
    assert Counter((r["doc_id"], r["source"], r["mix"]["taken"]) for r in again) == Counter((r["doc_id"], r["source"], r["mix"]["taken"]) for r in got)
    assert mixing.mix_sources(frame.limit(0), ["doc_id"]).count() == 0
    assert mixing.mix_sources(frame.filter(F.col("text").isNull()), ["doc_id"]).count() == 5
