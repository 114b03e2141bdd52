"""Ranked id files: exact round trips."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import idfiles


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=20), max_size=5))
def test_codes_round_trip(documents):
    packed = [idfiles.pack_codes(np.array(d, np.uint32)) for d in documents]
    counts = np.array([len(d) for d in documents], np.int64)
    got = idfiles.unpack_codes(b"".join(c for c, _ in packed), b"".join(d for _, d in packed), counts)
    assert got.tolist() == [x for d in documents for x in d]


def test_frequent_ids_take_one_byte():
    control, data = idfiles.pack_codes(np.array([0, 255, 256, 65_536, 2**24], np.uint32))
    assert len(control) == 2 and len(data) == 1 + 1 + 2 + 3 + 4


def files(spark, tmp_path, rows, **more):
    frame = spark.createDataFrame([(i, None if x is None else bytearray(np.array(x, "<u4").tobytes())) for i, x in rows], "doc_id long, ids binary").repartition(3)
    path = str(tmp_path / "ids")
    idfiles.write_ids(frame, path, **more)
    return idfiles.read_ids(spark, path)


def test_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.zipf(1.3, rng.integers(0, 50)).clip(max=49_000).tolist()) for i in rng.permutation(200)]
    got = files(spark, tmp_path, rows, file_bytes=2_000).orderBy("start", "doc_id").collect()
    start = 0
    for (i, ids), r in zip(sorted(rows), sorted(got, key=lambda r: r["doc_id"])):
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)


def test_ranks_are_by_frequency(spark, tmp_path):
    files(spark, tmp_path, [(1, [7, 7, 7, 3, 3, 9, 8])])
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "ids/ranks")).orderBy("code").collect()] == [7, 3, 8, 9]


def test_ties_nulls_empty(spark, tmp_path):
    got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in files(spark, tmp_path, [(None, [1]), (5, [2, 2]), (5, [2, 2]), (6, None)]).collect())
    assert got == [("5", 1, 2), ("5", 3, 2), ("6", 5, 0), ("None", 0, 1)]


def test_no_rows(spark, tmp_path):
    assert files(spark, tmp_path, []).count() == 0


def test_later_steps_drop_the_worker_s_encoder():
    import public_tokenizers

    from tarn.llm import tokens

    for step in (idfiles._counts(2), idfiles._to_codes(np.zeros(0, np.uint32), (np.zeros(0, np.int64),) * 2, 2), idfiles._to_blocks, idfiles._from_blocks(np.zeros(0, np.uint32))):
        tokens.encoder_of(str(public_tokenizers.path("word_bpe_49k.json")))
        list(step(iter([])))
        assert tokens.encoder_of.cache_info().currsize == 0
