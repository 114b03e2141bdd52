"""Ingestion, tables, requests and whole searches."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tarn.operators import upsert
from tarn.plans.engine import METHODS, Engine
from tarn.plans.settings import Settings
from tarn.sources import corpus
from tarn.sources.requests import RequestConflict, RequestRunning, Requests, request_hash

PAGES = {
    "docs/zh/docs/a.md": "---\ntitle: Security\n---\n# Security\n\n## OAuth2\n\nUse OAuth2PasswordBearer for tokens.\n\n## Bodies\n\nA request body is JSON.\n",
    "docs/zh/docs/sub/b.MD": "# Paths\n\nPath parameters are typed.\n",
    "docs/en/docs/c.md": "# English\n\nOther words entirely.\n",
    "docs/zh/docs/skip.txt": "no",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in PAGES.items():
        at = tmp_path / "corpus" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, "utf-8")
    return tmp_path / "corpus"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Settings(root=str(tmp_path / "engine"), embedding_dimensions=32, lists=2, nprobe=2, chunk_target=40, chunk_maximum=80, chunk_overlap=10))


def test_read_markdown(spark, tree):
    got = corpus.read_markdown(spark, str(tree))
    assert {r["source_path"] for r in got.collect()} == {"docs/zh/docs/a.md", "docs/zh/docs/sub/b.MD", "docs/en/docs/c.md"}
    one = corpus.read_markdown(spark, str(tree / "docs/zh/docs/a.md")).first()
    assert one["source_path"] == "a.md" and one["text"] == PAGES["docs/zh/docs/a.md"]
    assert {(r["language"], r["n_files"]) for r in corpus.count_by_language(spark, str(tree)).collect()} == {("zh", 2), ("en", 1)}
    with pytest.raises(ValueError):
        corpus.read_markdown(spark, str(tree / "docs/zh/docs/skip.txt"))
    with pytest.raises(ValueError):
        corpus.source_directory("x", "fr")


def test_evaluation_queries(spark, tmp_path):
    at = tmp_path / "q.json"
    at.write_text('[{"query": "oauth", "relevant_path_contains": ["a.md"], "category": "exact"}]')
    assert corpus.evaluation_queries(spark, str(at)).first()["query_id"] == 0
    for bad in ('[{"query": " ", "relevant_path_contains": ["a"], "category": "x"}]', '[{"query": "a", "category": "x"}]', '[{"query":"a","relevant_path_contains":["a"],"category":"x"},{"query":"a","relevant_path_contains":["a"],"category":"x"}]', "[]"):
        at.write_text(bad)
        with pytest.raises(ValueError):
            corpus.evaluation_queries(spark, str(at))


def test_ingest_is_incremental(spark, engine, tree):
    first = engine.ingest(str(tree / "docs/zh"), "repo", "c1", "zh")
    assert (first["documents"], first["chunks"], first["embedded"], first["deleted"]) == (2, 3, 3, 0)
    ids = {(r["document_id"], r["chunk_index"]): r["id"] for r in engine.chunks.collect()}
    assert engine.ingest(str(tree / "docs/zh"), "repo", "c1", "zh") == first  # the same request
    again = engine.ingest(str(tree / "docs/zh"), "repo", "c1", "zh", key="other")
    assert (again["embedded"], again["skipped"], again["deleted"]) == (0, 3, 0)
    (tree / "docs/zh/docs/a.md").write_text("---\ntitle: Security\n---\n# Security\n\n## OAuth2\n\nNew text.\n")
    third = engine.ingest(str(tree / "docs/zh"), "repo", "c1", "zh", key="third")
    assert (third["embedded"], third["skipped"], third["deleted"]) == (1, 1, 1)
    now = {(r["document_id"], r["chunk_index"]): r["id"] for r in engine.chunks.collect()}
    assert now == {k: v for k, v in ids.items() if k in now} and len(now) == 2
    engine.ingest(str(tree / "docs/zh"), "repo", "c2", "zh")  # another commit: new documents
    assert engine.status()["documents"] == 4 and engine.documents.select("id").distinct().count() == 4
    with pytest.raises(RequestConflict):
        engine.ingest(str(tree / "docs/zh"), "repo", "c3", "zh", key="third")


def test_search_all_ways(spark, engine, tree):
    engine.ingest(str(tree), "repo", "c1", "zh")
    engine.rebuild_bm25()
    queries = spark.createDataFrame([(0, "OAuth2PasswordBearer tokens"), (1, "path parameters"), (2, "zzz")], "query_id long, query string")
    answer = engine.search(queries, final_top_k=2, rerank_top_k=3)
    top = {r["query_id"]: (r["source_path"], r["title"]) for r in answer.results.filter("final_rank = 1").collect()}
    assert top[0] == ("docs/zh/docs/a.md", "Security") and top[1] == ("docs/zh/docs/sub/b.MD", None)
    status = {r["query_id"]: r["status"] for r in answer.confidence.collect()}
    assert status == {0: "not_flagged", 1: "not_flagged", 2: "unassessed"} or status[2] in ("low", "unassessed")
    assert answer.results.groupBy("query_id").count().agg(F.max("count")).first()[0] == 2
    plain = engine.search(queries, "ann", use_reranker=False)
    assert {r["status"] for r in plain.confidence.collect()} == {"unassessed"}
    assert engine.compare_rewrite(queries.filter("query_id < 2")).filter("rank_delta != 0").count() == 0
    with pytest.raises(ValueError):
        engine.search(queries, final_top_k=30, rerank_top_k=3)
    with pytest.raises(ValueError):
        engine.search(spark.createDataFrame([(0, " ")], "query_id long, query string"))
    hinted = spark.createDataFrame([(0, "OAuth2PasswordBearer tokens", ["a.md"], None), (1, "path parameters", None, ["PATHS"])], "query_id long, query string, relevant_path_contains array<string>, relevant_heading_contains array<string>")
    assert {"embedding", "dense", "bm25", "rerank", "total"} == set(answer.timings)
    assert engine.lists().chunks.count() == 4 and engine.lists() is engine.lists()
    again = Engine(spark, engine.settings)
    assert again.lists().centers.tolist() == engine.lists().centers.tolist()  # read, not built anew
    side = engine.compare(queries.filter("query_id = 0"), 2).collect()
    assert {r["exact_rank"] for r in side} >= {1, 2} and min(r["bm25_rank"] for r in side if r["bm25_rank"]) == 1
    one_by_one = engine.benchmark(hinted.limit(1), each=True).filter("method = 'bm25'").first()
    assert one_by_one["mrr_10"] == 1.0 and one_by_one["mean_ms"] == one_by_one["p95_ms"] > 0
    report = {r["method"]: r for r in engine.benchmark(hinted).collect()}
    assert set(report) == set(METHODS) and report["bm25"]["mrr_10"] == 1.0 and report["rrf_rerank"]["recall_5"] == 1.0
    assert all(r["ok"] for r in engine.doctor().collect())


def test_settings_name_services_aliases_and_a_segmenter(spark, tmp_path, tree):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), asked["model"]))
            if self.path == "/embed":
                made = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(asked["input"])]}
            else:
                made = {"results": [{"index": i, "relevance_score": float("typed" in t)} for i, t in enumerate(asked["documents"])]}
            raw = json.dumps(made).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    service = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    (tmp_path / "aliases.json").write_text('{"version": 1, "aliases": {"xx": "path parameters"}}')
    at = f"http://127.0.0.1:{service.server_port}"
    os.environ["TEST_SERVICE_KEY"] = "secret"
    made = Engine(spark, Settings(root=str(tmp_path / "s"), embedding_model="two", embedding_dimensions=2, embedding_url=f"{at}/embed", rerank_url=f"{at}/rerank", rerank_model="r", key_variable="TEST_SERVICE_KEY", alias_path=str(tmp_path / "aliases.json"), segmenter="builtins:list"))
    assert made.segmenter is list
    made = Engine(spark, Settings(**vars(made.settings) | {"segmenter": ""}))
    made.ingest(str(tree), "r", "c", "en")
    made.rebuild_bm25()
    answer = made.search(spark.createDataFrame([(0, "xx")], "query_id long, query string"), use_rewrite=True)
    assert answer.queries.first()["effective_query"] == "path parameters (xx)"
    assert answer.results.filter("final_rank = 1").first()["source_path"] == "docs/zh/docs/sub/b.MD"
    calls = len(seen)
    assert answer.confidence.first()["score"] == 1.0 and answer.results.count() > 1 and len(seen) == calls  # no model is asked again
    assert {(p, k, m) for p, k, m in seen} == {("/embed", "Bearer secret", "two"), ("/rerank", "Bearer secret", "r")}
    service.shutdown()


def test_doctor_names_what_is_missing(engine):
    found = {r["check"]: (r["ok"], r["detail"]) for r in engine.doctor().collect()}
    assert found["bm25"] == (False, "IndexMissing") and found["tables"] == (False, "LookupError") and not found["vector space"][0]
    assert engine.tables.current() is None  # looking writes nothing


def test_embedder_and_scorer_are_called(spark, tmp_path, tree):
    made = Engine(spark, Settings(root=str(tmp_path / "e"), embedding_dimensions=2, embedding_model="two"), lambda texts: [[float(len(t)), 1.0] for t in texts], lambda q, t: [float(len(x)) for x in t])
    made.ingest(str(tree), "r", "c", "en")
    made.rebuild_bm25("k")
    assert made.rebuild_bm25("k") == made.rebuild_bm25("k")
    got = made.search(spark.createDataFrame([(0, "words")], "query_id long, query string")).results.orderBy("final_rank").collect()
    lengths = [len(r["retrieval_text"]) for r in got]
    assert lengths == sorted(lengths, reverse=True) and len(got) == 4


def test_requests(spark, tmp_path):
    requests = Requests(spark, str(tmp_path))
    wanted = request_hash({"b": 1, "a": "字"})
    assert wanted == request_hash({"a": "字", "b": 1})
    assert requests.claim("k", wanted) is None
    with pytest.raises(RequestRunning):
        requests.claim("k", wanted)
    with pytest.raises(RequestConflict):
        requests.claim("k", "other")
    requests.fail("k", wanted)
    assert requests.claim("k", wanted) is None
    requests.complete("k", wanted, {"n": 1})
    assert requests.claim("k", wanted) == {"n": 1}
    with pytest.raises(RequestConflict):
        requests.complete("k", wanted, {})


def test_upsert_and_numbers(spark):
    of = "id long, a string, b int, v string"
    current = spark.createDataFrame([(5, "x", 1, "old"), (7, "y", 1, "old")], of)
    new = spark.createDataFrame([("x", 1, "new"), ("z", 2, "new"), ("z", 1, "new")], "a string, b int, v string")
    got = {tuple(r) for r in upsert.upsert(current, new, ["a", "b"], "id").collect()}
    assert got == {(5, "x", 1, "new"), (7, "y", 1, "old"), (8, "z", 1, "new"), (9, "z", 2, "new")}
    many = upsert.with_new_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"], "n", 10)
    assert many.filter("n != k + 10").count() == 0


@pytest.mark.parametrize("bad", [{"root": " "}, {"final_top_k": 0}, {"final_top_k": 30}, {"chunk_overlap": 1600}, {"embedding_dimensions": -1}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        Settings(**{"root": "r"} | bad)


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("TARN_ROOT", "/r")
    monkeypatch.setenv("TARN_DENSE_TOP_K", "7")
    assert (Settings.from_environment().root, Settings.from_environment(dense_top_k=9).dense_top_k, Settings.from_environment().dense_top_k) == ("/r", 9, 7)


def test_only_one_writer_follows_a_generation(spark, tmp_path):
    from tarn.sources.pointers import ConcurrentChange, Generations

    store = Generations(spark, str(tmp_path))
    first, second, third = (store.new()[0] for _ in range(3))
    store.publish(first, {})
    store.publish(second, {}, after=first)
    with pytest.raises(ConcurrentChange):
        store.publish(third, {}, after=first)
    assert store.current() == second
    # a writer died between creating its pointer and filling it
    assert store.files.create(f"{tmp_path}/CURRENT-0000000003", "")
    store.SLOW = 0.2
    assert store.current() == second
    store.publish(third, {}, after=second)
    assert store.current() == third
    store.files.write(f"{tmp_path}/CURRENT-0000000099", "../x")
    with pytest.raises(ValueError):
        store.current()
