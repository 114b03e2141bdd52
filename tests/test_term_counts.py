"""Terms counted in Arrow against the terms as an expression."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.functions.text import has_ascii_terms, terms
from tarn.operators import bm25

TEXTS = [
    None, "\u212aelvin \u212ax", "", " ", "Plain words, Plain WORDS.", "v1.2.3 and 1.5.2.7", "a.b..c a. b", "_x 3x x3_y 12_3", "été Ça ÉCOLE déjà vu", "déjà_vu", "中文 words 中文字", "Kelvin İx", "١٢ १ 12 1١", "x" * 3000, "9 10 9", "a²b", "end.", ".start", "߁ ꘠",
    "tab\tline\nnew space", "q-w e'r",
]


def test_counts_equal_those_of_the_expression(spark, monkeypatch):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aB9_. é中\n-") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, retrieval_text string").repartition(3)
    want = {r[0]: Counter(r[1]) for r in frame.select("chunk_id", terms(F.col("retrieval_text"))).collect()}
    got = {r["chunk_id"]: r for r in bm25.tokenized(frame).collect()}
    assert set(got) == set(want)
    for i, row in got.items():
        assert {c["term"]: c["tf"] for c in row["counts"]} == want[i] and len(row["counts"]) == len(want[i]) and row["dl"] == want[i].total(), texts[i]


def test_terms_of_other_texts_only_are_cut_in_the_jvm(spark):
    """Cutting, sorting and counting terms as arrays took most of the time that an index takes."""
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", has_ascii_terms(F.col("t")).alias("ascii"))
    assert {r["t"] for r in frame.collect() if not r["ascii"]} == {t for t in TEXTS if t is None or any(ord(c) > 0x63F for c in t)}


def test_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(text, "SLICE_BYTES", 20)
    texts = [f"word{k % 7} a.b {k}" * (k % 5) if k % 6 else None for k in range(60)]
    given = [["given", "given"] if t is None or k % 11 == 0 else None for k, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts), pa.array(given, pa.list_(pa.string()))], ["id", "text", "terms"])
    rows = [r for b in text.term_counts(iter([batch.slice(3)])) for r in b.to_pylist()]
    assert [r["chunk_id"] for r in rows] == list(range(3, 60))
    for r in rows:
        k = r["chunk_id"]
        want = given[k] or [w.decode() for w in re.findall(text.ASCII_TERM, texts[k].encode())]
        assert {c["term"]: c["tf"] for c in r["counts"]} == Counter(want) and r["dl"] == len(want)
