"""Ids of whole texts against the tokenizer called on each text."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarn.llm.tokens import Encoder, encode_texts, slices

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
PLAIN = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
PIECES = ["word", "Word,", "it's", "don't.", "'s!", "a.b", "x1,", "7;", "é", "é,", "≠", " ", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>.", " ", "\n", "\t\r", "\x0b", "漢字", "🎉!", "İ", "...", "?", "Σ", "́", "\x00", "H\u0331", "T\u0308a", "CAPS,", "MiXed"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=30)), max_size=5))
def test_equals_plain(texts):
    texts = [t for t in texts if t.isprintable() or not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    ids, rows = ENCODER(pa.array(texts, pa.string()), 1)
    want = [[*x.ids, 1] for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])] == want


def test_many_new_parts_at_once():
    encoder, texts = Encoder(PATH), [" ".join(f"{a}{b}{c}" for b in "xyzäİßﬁ") for a in ("word", "Ünder", "9", "a-") for c in map(chr, range(0x61, 0x300))]
    ids, rows = encoder(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c"])
    got = list(slices(texts, 12))
    assert [i for a, b in got for i in range(a, b)] == list(range(5))


def test_nulls_and_repeats(spark):
    rows = [(1, "A word, twice"), (1, "A word, twice"), (None, None), (3, ""), (4, "x " * 20_000)]
    got = encode_texts(spark.createDataFrame(rows, "id long, text string"), PATH, ["id"], end_id=5).collect()
    assert sorted((r["id"] or 0, r["n_tokens"]) for r in got) == sorted((k or 0, len(PLAIN.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in rows)
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 5 for r in got)


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "id long, text string"), PATH, ["id"]).count() == 0
