"""The queries that SQL cannot express, on whole small tables, against plain Python."""

import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def encoded():
    """(doc_id, ids) of every whole text."""
    plain = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id")
    return [(int(i), plain.encode(t or "", add_special_tokens=False).ids) for i, t in zip(docs.doc_id, docs.text)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_every_piece_once(spark, encoded):
    got = __spark_entry__.queries()["op1_best_fit_packing"](spark, FOLDER).collect()
    want = [(i, k // 4096, k, len((ids + [1])[k : k + 4096]), crc((ids + [1])[k : k + 4096])) for i, ids in encoded for k in range(0, len(ids) + 1, 4096)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(len(ids) + 1 for _, ids in encoded) // 4096)


def test_id_files_read_back_what_was_encoded(spark, encoded):
    got = __spark_entry__.queries()["op7_ranked_id_files"](spark, FOLDER).collect()
    starts = np.cumsum([0, *(len(ids) + 1 for _, ids in encoded)]).tolist()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(i, at, len(ids) + 1, crc(ids + [2])) for (i, ids), at in zip(encoded, starts)]
