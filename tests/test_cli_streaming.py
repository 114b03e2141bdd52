"""Command line, streaming ingestion, EPUB books, and the driver's entry points."""

import json
import zipfile

import pytest

import __spark_entry__
from tarn import cli
from tarn.plans.engine import Engine
from tarn.plans.settings import Settings
from tarn.sources.corpus import read_epub
from tarn.streaming.ingest import ingest_stream


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a b.md").write_text("# A\n\nalpha beta\n")
    return at


def test_command_line(spark, tmp_path, folder, capsys, monkeypatch):
    monkeypatch.setenv("TARN_EMBEDDING_DIMENSIONS", "16")
    root = ["--root", str(tmp_path / "root")]

    def out(*words, code=0):
        assert cli.run(spark, [*root, *words]) == code
        return capsys.readouterr().out

    assert json.loads(out("init"))["embedding_dimensions"] == 16
    out("doctor", code=1)
    assert json.loads(out("ingest", str(folder), "--repo", "r", "--commit", "c", "--language", "en"))["chunks"] == 1
    assert json.loads(out("rebuild"))["chunks"] == 1
    assert json.loads(out("status"))["documents"] == 1
    assert json.loads(out("--json", "history"))["chunks"] == 1
    lines = [json.loads(x) for x in out("--json", "search", "alpha", "--rewrite").splitlines()]
    assert lines[0]["source_path"] == "a b.md" and lines[1]["status"] == "not_flagged"
    assert "a b.md" in out("search", "beta", "--no-rerank", "--mode", "ann")
    assert json.loads(out("--json", "compare-rewrite", "alpha"))["rank_delta"] == 0
    with pytest.raises(ValueError):
        cli.run(spark, [*root, "search", "alpha", "--top-k", "0"])


def test_streaming_takes_new_files_once(spark, tmp_path, folder):
    engine = Engine(spark, Settings(root=str(tmp_path / "root"), embedding_dimensions=16))

    def run():
        query = ingest_stream(engine, str(folder), str(tmp_path / "checkpoint"), "r", "c", "en")
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert engine.documents.count() == 1
    (folder / "sub").mkdir()
    (folder / "sub" / "b.md").write_text("# B\n\ngamma\n")
    run()
    assert {r["source_path"] for r in engine.documents.collect()} == {"a b.md", "sub/b.md"}
    found = engine.search(spark.createDataFrame([(0, "gamma")], "query_id long, query string")).results
    assert found.orderBy("final_rank").first()["source_path"] == "sub/b.md"
    before = engine.tables.current()
    run()
    assert engine.tables.current() == before


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as book:
        book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        book.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><metadata><title xmlns="http://purl.org/dc/elements/1.1/">Book</title></metadata><manifest><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="c"/><itemref idref="a"/></spine></package>')
        book.writestr("O/nav.xhtml", "<p>nav</p>")
        book.writestr("O/a b.xhtml", "<h1>One</h1><p>text</p>")
        book.writestr("O/c.xhtml", "<title>Two</title><p>more</p>")
    got = read_epub(spark, str(tmp_path)).orderBy("chapter").collect()
    assert [(r["name"], r["text"], json.loads(r["frontmatter"])) for r in got] == [("c.xhtml", "## Two\n\nmore", {"title": "Book"}), ("a b.xhtml", "## One\n\ntext", {"title": "Book"})]


def test_entry_points():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {"hybrid_topk", "bm25_topk", "dense_exact_topk"} <= set(sql)
