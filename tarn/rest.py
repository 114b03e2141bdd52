"""The engine over HTTP, with the standard library's server; for a few users, not a gateway."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from tarn.operators.bm25 import EmptyCorpus, IndexMismatch, IndexMissing
from tarn.operators.rewrite import BadAliases
from tarn.plans.engine import Engine
from tarn.sources.pointers import ConcurrentChange
from tarn.sources.requests import RequestConflict, RequestRunning

#: Kinds of failures and the answers to them, the first that fits.
STATUS = (
    ((RequestConflict, RequestRunning, ConcurrentChange), 409),
    ((IndexMissing, IndexMismatch, EmptyCorpus, BadAliases), 503),
    ((FileNotFoundError,), 404),
    ((ValueError, KeyError, TypeError), 422),
)


class Api:
    """Requests as plain calls: (status, payload)."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def call(self, method: str, path: str, body: dict, key: str | None = None) -> tuple[int, object]:
        routes = {
            ("GET", "/health/live"): lambda: {"status": "ok"}, ("GET", "/health/ready"): self.ready, ("GET", "/v1/stats"): self.engine.status,
            ("POST", "/v1/search"): lambda: self.search(**body), ("POST", "/v1/ingest"): lambda: self.ingest(key, **body), ("POST", "/v1/bm25/rebuild"): lambda: self.rebuild(key),
        }
        if (method, path) not in routes:
            return 404, {"error": "no such path"}
        try:
            got = routes[method, path]()
        except Exception as error:  # noqa: BLE001  each kind has its answer
            status = next((s for kinds, s in STATUS if isinstance(error, kinds)), 404 if "PATH_NOT_FOUND" in str(error) else 500)
            return status, {"error": type(error).__name__ if status == 500 else str(error)}
        return (503 if path == "/health/ready" and not got["ready"] else 200), got

    def ready(self) -> dict:
        checks = [r.asDict() for r in self.engine.doctor().collect()]
        return {"ready": all(c["ok"] for c in checks), "checks": checks}

    def search(self, query: str, mode: str = "exact", rerank: bool = True, rewrite: bool = False, **top_k: int) -> dict:
        queries = self.engine.spark.createDataFrame([(0, query)], "query_id long, query string")
        answer = self.engine.search(queries, mode, rerank, rewrite, **top_k)
        results = answer.results.drop("query_id", "query").orderBy("final_rank").select(F.to_json(F.struct("*")))
        asked = answer.queries.select("normalized_query", "effective_query", "applied_rules").first().asDict()
        return {"query": query, "rewrite": asked, "reranker_used": rerank, "results": [json.loads(r[0]) for r in results.collect()], "confidence": answer.confidence.drop("query_id").first().asDict(), "timings_ms": answer.timings}

    def ingest(self, key: str | None, source: str, repo: str, commit: str, language: str, root: str | None = None) -> dict:
        return self.engine.ingest(source, repo, commit, language, root, key)

    def rebuild(self, key: str | None) -> dict:
        if not key:
            raise ValueError("an Idempotency-Key header is required")
        return self.engine.rebuild_bm25(key)


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, payload = api.call(method, self.path, body, self.headers.get("Idempotency-Key")) if isinstance(body, dict) else (422, {"error": "the body must be an object"})
            except ValueError:
                status, payload = 422, {"error": "the body is not JSON"}
            raw = json.dumps(payload, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
