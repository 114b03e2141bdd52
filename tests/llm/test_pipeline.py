"""The pipeline against its stages in plain Python, on a small corpus; and the registered queries."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from test_contamination import brute as contaminated
from test_neardup import brute as classes
from test_neardup import edited
from test_passages import brute as removed
from test_quality import counts
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

PLAIN = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "Ra") for b in ("sa", "te", "vo", "zi", "xu", "wy", "be", "do", "")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, items = text(60), [text(20), text(5)]
    originals = [text(rng.randint(30, 150)) for _ in range(30)]
    rows = []
    for i in range(80):
        words = edited(rng, originals[i % 30], 0.01) if i % 4 == 0 else text(rng.randint(15, 200))
        if i % 9 == 1:
            words[5:5] = passage
        if i % 13 == 2:
            words[3:3] = items[0]
        if i % 17 == 3:
            words = words[:8]
        if i % 19 == 4:
            words = words[:10] * 8
        rows.append((i * 3 + 1, " ".join(words), "en", f"src{i % 3}"))
    rows += [(1000, None, None, None), (1001, "", "en", "src0"), (1002, " ".join(originals[0]), "en", "src1"), (1003, " ".join(text(6000)), "en", "src0"), (1004, " ".join(passage), "en", "src2")]
    rng.shuffle(rows)
    return rows, [(i, " ".join(w)) for i, w in enumerate(items)]


def write(folder, rows, items, extra=None):
    frame = pd.DataFrame([(*r, len(r[1] or "")) for r in rows], columns=COLUMNS).astype({"n_chars": "int64", "doc_id": "int64"})
    for name, value in (extra or {}).items():
        frame[name] = value
    frame.to_parquet(folder / "documents.parquet", index=False)
    pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "int64", "text": "str"}).to_parquet(folder / "benchmark.parquet", index=False)
    return str(folder)


def expected(rows, items):
    """(doc_id, text) after the first four stages. No document here is beyond an adaptive fence."""
    left = [(i, t) for i, t, _, _ in rows if (c := counts(t))["n_words"] >= 10 and 100 * c["n_repeat_words"] <= 20 * c["n_words"]]
    of = classes(left)
    left = [(i, t) for i, t in left if of[i] == i]
    texts = dict(left)
    left = [(i, kept if n else texts[i]) for i, total, n, kept, _ in removed(left, 13) if n == 0 or n < total]
    bad = {i for i, _, _, _, hit, _ in contaminated(left, items, 13) if hit}
    return [(i, t) for i, t in left if i not in bad]


def test_equals_its_stages(spark, tmp_path):
    rows, items = corpus()
    got = corpus_pipeline.run(spark, write(tmp_path, rows, items)).collect()
    want = []
    for i, t in expected(rows, items):
        ids = [*PLAIN.encode(t, add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(part := ids[k : k + 4096]), zlib.crc32(np.array(part, "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert 30 < len(want) < 84
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert all(offset == sum(n for _, n in parts[:k]) for k, (offset, _) in enumerate(parts)) and sum(n for _, n in parts) <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in got) // 4096)


def test_stages_keep_columns_and_accept_clashing_ones(spark, tmp_path):
    rows, items = corpus()
    folder = write(tmp_path, rows[:30], items, {"n_words": 7, "row": "r", "quality": 1.5, "stays": False, "k0": "x", "class_id": 3, "items": "i", "kept": "k"})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        schema = [(f.name, f.dataType) for f in docs.schema]
        docs = stage(spark, docs, folder)
        assert [(f.name, f.dataType) for f in docs.schema] == schema
    assert {(r["n_words"], r["row"], r["kept"]) for r in docs.collect()} == {(7, "r", "k")}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path, [], [(1, "a b")])).count() == 0


def test_registered_queries_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    numbers = [n.split("_")[0] for n in queries if n.startswith("op") and n[2].isdigit()]
    assert sorted(numbers, key=lambda n: int(n[2:])) == [f"op{k}" for k in range(1, 14)]
    assert "pipeline" in queries and set(sql) <= set(queries)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "benchmark decontamination", "best-fit packing"]


@pytest.mark.parametrize("name", [f for f in __spark_entry__.queries() if f.startswith("op")])
def test_queries_accept_empty_tables(spark, tmp_path, name):
    documents = pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "text": pd.Series(dtype="str"), "lang": pd.Series(dtype="str"), "source": pd.Series(dtype="str"), "n_chars": pd.Series(dtype="int64")})
    tables = {
        "documents": documents, "benchmark": pd.DataFrame({"item_id": pd.Series(dtype="int64"), "text": pd.Series(dtype="str")}), "pages": pd.DataFrame({"page_id": pd.Series(dtype="int64"), "url": pd.Series(dtype="str"), "html": pd.Series(dtype="str")}),
        "conversations": pd.DataFrame({"conv_id": pd.Series(dtype="int64"), "turn": pd.Series(dtype="int64"), "role": pd.Series(dtype="str"), "text": pd.Series(dtype="str")}),
    }
    for table, frame in tables.items():
        frame.astype({c: "string" for c in frame.columns if frame[c].dtype != "int64"}).to_parquet(tmp_path / f"{table}.parquet", index=False)
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() == 0
