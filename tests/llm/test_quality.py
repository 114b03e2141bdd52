"""Quality rules: base counts against plain Python, fences against sorted values."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[p : p + 5]) for p in range(len(words) - 4)]
    again = {q for p, g in enumerate(grams) if grams.count(g) > 1 for q in range(p, p + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(again)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab #|\n\t\x0b\r\x1f é　𝒳", max_size=60)), min_size=1, max_size=30))
def test_base_counts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: r["c"].asDict() for r in quality.base_counts(rows, "text", "c").collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


@given(st.integers(0, 2**40))
@settings(max_examples=300, deadline=None)
def test_bucket_bounds(value):
    shift = max(0, value.bit_length() - 6)
    bucket = shift * 32 + (value >> shift)
    shift_back = max(0, bucket // 32 - 1)
    top = ((bucket - shift_back * 32 + 1) << shift_back) - 1
    assert value <= top <= value + value // 32


def test_buckets_in_spark(spark):
    values = [*range(300), 1023, 1024, 2**20 + 7, 2**40]
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality.bucket_of(F.col("v"))).withColumn("top", quality.bucket_top(F.col("b")))
    for r in rows.collect():
        shift = max(0, r["v"].bit_length() - 6)
        assert r["b"] == shift * 32 + (r["v"] >> shift) and r["v"] <= r["top"] <= r["v"] * 33 // 32


def corpus(n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 80))]
        if i % 50 == 7:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 4 else "fr", "hot" if i % 3 == 0 else f"s{i % 4}"))
    return rows


def fence_of(weights):
    """Fence of {bucket's largest value: weight}."""
    total, values = sum(weights.values()), {}
    for q in (5, quality.TAIL):
        up_to = 0
        for top in sorted(weights):
            up_to += weights[top]
            if 10 * up_to >= q * total:
                values[q] = top
                break
    return values[quality.TAIL] + quality.REACH * (values[quality.TAIL] - values[5])


def is_beyond(count, size, scale, unit, fence):
    return count * scale > fence * size and count - fence * size / scale > quality.Z * (unit * count) ** 0.5


def expected_fences(rows, value, prior):
    """Fence of each (lang, source) of rows (lang, source, counts), from whole sketches in plain Python."""
    top = lambda v: (lambda s: (((v >> s) + 1) << s) - 1)(max(0, v.bit_length() - 6))
    tally = {}
    for lang, source, c in rows:
        for key in ((lang, source), lang, None):
            own = tally.setdefault(key, {})
            own[top(value(c))] = own.get(top(value(c)), 0) + quality.PARTS

    def with_prior(own, above):
        return {t: own.get(t, 0) + above.get(t, 0) * prior * quality.PARTS // sum(above.values()) for t in {*own, *above}}

    of_lang = {k: with_prior(w, tally[None]) for k, w in tally.items() if isinstance(k, str)}
    bound = {k: quality.LIMIT * fence_of(w) for k, w in of_lang.items()}
    return {k: min(fence_of(with_prior(w, of_lang[k[0]])), bound[k[0]]) for k, w in tally.items() if isinstance(k, tuple)}


@pytest.mark.parametrize("prior", [1, 40, 10_000])
def test_fences_by_group_language_and_all(spark, prior):
    rows = corpus()
    got = {r["doc_id"]: r["quality"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior_rows=prior).collect()}
    assert len(got) == len(rows)
    for name, (count, size, scale, unit) in quality.MEASURES.items():
        fences = expected_fences([(lang, source, counts(t)) for _, t, lang, source in rows], lambda c: c[count] * scale // c[size], prior)
        for i, t, lang, source in rows:
            assert (name in got[i]["beyond"]) == is_beyond(counts(t)[count], counts(t)[size], scale, unit, fences[lang, source]), (i, name)
    assert not got[7]["kept"] and got[8]["kept"]


def marked(rng, marks, n=400):
    """n words, that many of them with a symbol."""
    return " ".join(f"w{rng.randint(0, 5000)}" + "#" * (k < marks) for k in range(n))


def test_large_groups_judge_by_themselves_and_small_ones_with_their_language(spark):
    """A source of code-like texts keeps them, a source with three such texts does not, and one that is
    all junk cannot set its fence beyond LIMIT times its language's."""
    rng = random.Random(1)
    rows = [(marked(rng, rng.randint(0, 8)), "plain") for _ in range(3000)] + [(marked(rng, rng.randint(56, 72)), "code") for _ in range(150)] + [(marked(rng, 56), "small") for _ in range(3)] + [(marked(rng, 400), "junk") for _ in range(75)]
    frame = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = quality.quality_rules(frame, ["source"]).groupBy("source").agg(F.avg(F.col("quality.kept").cast("int")).alias("share")).collect()
    assert {r["source"]: r["share"] for r in kept} == {"plain": 1.0, "code": 1.0, "small": 0.0, "junk": 0.0}


@pytest.mark.parametrize("usual, kept", [((0, 8), False), ((40, 70), True)])
def test_the_same_document_is_judged_by_its_group(spark, usual, kept):
    """Nothing but the group's own spread decides whether 60 symbols in 400 words are too many."""
    rng = random.Random(2)
    rows = [(i, marked(rng, rng.randint(*usual)), "en", "s") for i in range(600)] + [(-1, marked(rng, 60), "en", "s")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    judged = {r["doc_id"]: r["quality"]["kept"] for r in got.collect()}
    assert judged.pop(-1) == kept and all(judged.values())


def test_a_tenth_of_junk_moves_no_fence_and_one_symbol_is_no_verdict(spark):
    rng = random.Random(3)
    rows = [(i, marked(rng, 0, 40), "en", "s") for i in range(300)] + [(1000 + i, marked(rng, 35, 40), "en", "s") for i in range(30)] + [(2000, marked(rng, 1, 40), "en", "s"), (2001, marked(rng, 60, 2400), "en", "s")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    judged = {r["doc_id"]: r["quality"]["kept"] for r in got.collect()}
    assert all(judged[i] == (i < 1000 or i == 2000) for i in judged)


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s"), (3, "same line of words\n" * 10, "en", None), (None, " ".join(f"w{i}" for i in range(60_000)), "en", "s"), (4, "nine words are too few for this base rule", "en", "s")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, counts string, fence int")
    got = quality.quality_rules(frame).collect()
    assert len(got) == 6 and {r["counts"] for r in got} == {"x"} and set(got[0].asDict()) == {*frame.columns, "quality"}
    assert {str(r["doc_id"]): (r["quality"]["base_failed"], r["quality"]["kept"]) for r in got} == {"1": (True, False), "2": (True, False), "3": (True, False), "None": (False, True), "4": (True, False)}
    assert quality.quality_rules(frame.limit(0)).count() == 0


def test_plan_has_no_python(spark, capsys):
    quality.quality_rules(spark.createDataFrame(corpus(20), "doc_id long, text string, lang string, source string")).explain()
    assert "Python" not in capsys.readouterr().out
