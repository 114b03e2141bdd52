"""The HTTP surface."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from tarn.plans.engine import Engine
from tarn.plans.settings import Settings
from tarn.rest import server


@pytest.fixture
def call(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nalpha beta\n\n## B\n\ngamma\n")
    made = server(Engine(spark, Settings(root=str(tmp_path / "root"), embedding_dimensions=16)), port=0)
    threading.Thread(target=made.serve_forever, daemon=True).start()

    def ask(method, path, body=None, key=None):
        request = urllib.request.Request(f"http://127.0.0.1:{made.server_port}{path}", None if body is None else json.dumps(body).encode(), {"Idempotency-Key": key} if key else {}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    yield ask
    made.shutdown()


def test_workflow(call, tmp_path):
    assert call("GET", "/health/live") == (200, {"status": "ok"})
    assert call("GET", "/health/ready")[0] == 503
    assert call("POST", "/v1/search", {"query": "alpha"})[0] == 503
    body = {"source": str(tmp_path / "in"), "repo": "r", "commit": "c", "language": "en"}
    status, first = call("POST", "/v1/ingest", body, "k")
    assert status == 200 and first["chunks"] == 2
    assert call("POST", "/v1/ingest", body, "k") == (200, first)
    assert call("POST", "/v1/ingest", body | {"commit": "d"}, "k")[0] == 409
    assert call("POST", "/v1/ingest", body | {"source": str(tmp_path / "none")})[0] == 404
    assert call("POST", "/v1/bm25/rebuild", {})[0] == 422
    assert call("POST", "/v1/bm25/rebuild", {}, "k")[0] == 200
    assert call("GET", "/v1/stats")[1]["chunks"] == 2
    status, found = call("POST", "/v1/search", {"query": "gamma", "final_top_k": 1})
    assert status == 200 and [r["heading_path"] for r in found["results"]] == [["A", "B"]] and found["confidence"]["status"] == "not_flagged"
    assert call("POST", "/v1/search", {"query": " "})[0] == 422
    assert call("POST", "/v1/search", {"query": "x", "final_top_k": 0})[0] == 422
    assert call("POST", "/v1/search", {"question": "x"})[0] == 422
    assert call("GET", "/nothing")[0] == 404
    assert call("GET", "/health/ready")[0] == 200
