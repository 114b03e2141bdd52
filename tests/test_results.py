"""Results as JSON lines and back, counts of documents, and the history of requests."""

import pytest
from pyspark.errors import PySparkException

from tarn.functions.results import from_lines, to_lines
from tarn.operators import upsert
from tarn.plans.engine import Engine
from tarn.plans.settings import Settings
from tarn.sources.requests import Requests

TYPES = "id long not null, name string, at timestamp, score double, path array<string>, about map<string,string>, of struct<a:int,b:string>"


def test_lines_give_the_same_rows(spark):
    rows = spark.sql("""
        select 1L id, 'A "quoted"\nline é 漢' name, timestamp '2024-02-29 12:00:00.123456' at, 0.1D score, array('x', null, '') path, map('k', 'v') about, named_struct('a', 1, 'b', null) of
        union all select 9007199254740993, '', null, -1e300, array(), map(), null union all select 3, null, null, null, null, null, null""")
    lines = to_lines(rows)
    assert lines.columns == ["line"] and lines.filter("line not like '%\"score\":%'").isEmpty()
    back = from_lines(lines, rows.schema, ["id"])
    assert back.dtypes == rows.dtypes
    assert back.orderBy("id").collect() == rows.orderBy("id").collect()
    assert from_lines(lines.limit(0), TYPES).count() == 0


@pytest.mark.parametrize("line", [None, "", "[1]", "7", "null", "{", '{"id": "one"}', '{"id": 1.5}', '{"name": "x"}', '{"id": null}'])
def test_what_is_no_result_is_told(spark, line):
    with pytest.raises(PySparkException, match="stored count is invalid"):
        from_lines(spark.createDataFrame([(line,)], "line string"), TYPES, what="count").collect()


def test_unknown_fields_are_left_out_and_optional_ones_null(spark):
    row = from_lines(spark.createDataFrame([('{"id": 5, "more": [1]}',)], "line string"), TYPES).first()
    assert row["id"] == 5 and row["name"] is None and "more" not in row


@pytest.mark.parametrize("batch", [1, 2, 3, 100])
def test_requests_of_documents(spark, batch):
    changed = {1: [True] * 5, 2: [False] * 3, 3: [True, False, True], None: [True]}
    judged = spark.createDataFrame([(d, c) for d, cs in changed.items() for c in cs], "document_id long, is_changed boolean")
    got = {r["document_id"]: (r["chunks"], r["embedded"], r["skipped"], r["requests"]) for r in upsert.per_document(judged, batch).collect()}
    assert got == {d: (len(c), sum(c), len(c) - sum(c), -(-sum(c) // batch)) for d, c in changed.items()}
    total = upsert.totals(upsert.per_document(judged, batch)).first()
    assert total["requests"] == sum(-(-sum(c) // batch) for c in changed.values()) and total["documents"] == 4
    assert upsert.totals(upsert.per_document(judged.limit(0), batch)).first()["requests"] == 0


def test_outcomes_of_requests(spark, tmp_path):
    requests = Requests(spark, str(tmp_path))
    assert requests.outcomes().count() == 0
    assert requests.once("good", {"a": 1}, lambda: {"n": 3, "text": "é/attempt"}) == {"n": 3, "text": "é/attempt"}
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            requests.once("bad", {"a": 2}, lambda: {"n": 1 // 0})
    requests.take("open", "hash")  # under work: no outcome yet
    got = sorted(((r["key"], r["attempt"], r["status"], r["result"]) for r in requests.outcomes().collect()), key=str)
    assert got == [("bad", 1, "failed", None), ("bad", 2, "failed", None), ("good", 1, "completed", '{"n":3,"text":"é/attempt"}')]
    assert requests.outcomes().filter("at is null").isEmpty()


def test_history_of_ingestions(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\nalpha\n\n## B\n\nbeta\n")
    (folder / "b.md").write_text("# C\n\ngamma\n")
    engine = Engine(spark, Settings(root=str(tmp_path / "root"), embedding_dimensions=16, embedding_batch_size=1))
    assert engine.ingestions.count() == 0
    first = engine.ingest(str(folder), "r", "c", "en", key="one")
    engine.ingest(str(folder), "r", "c", "en", key="two")
    engine.rebuild_bm25("index")
    assert first["requests"] == first["embedded"] == 3 and list(first["timings_ms"]) == ["parse", "chunk", "embed", "write"]
    assert 0 < sum(first["timings_ms"].values()) <= 1000 * first["seconds"] + 1
    rows = {r["key"]: r.asDict() for r in engine.ingestions.collect()}
    assert set(rows) == {"one", "two"} and {k: rows["one"][k] for k in first} == first
    assert (rows["two"]["embedded"], rows["two"]["skipped"], rows["two"]["requests"]) == (0, 3, 0)
    engine.requests.once("broken", {}, lambda: {"documents": "many"})
    with pytest.raises(PySparkException, match="stored ingestion is invalid"):
        engine.ingestions.collect()
