"""Command line: ``python -m tarn --root DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import preview
from tarn.plans.engine import Engine
from tarn.plans.settings import Settings
from tarn.rest import server
from tarn.sources.corpus import evaluation_queries


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarn", description="Hybrid retrieval on Spark tables.")
    top.add_argument("--root", help="folder of the tables; else TARN_ROOT")
    top.add_argument("--json", action="store_true", help="rows as JSON lines")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("init", "create empty tables"), ("status", "generation and counts"), ("doctor", "check what a search needs"), ("history", "what the ingestions reported")):
        commands.add_parser(name, help=text)
    ingest = commands.add_parser("ingest", help="take in Markdown files")
    ingest.add_argument("source")
    for name in ("repo", "commit", "language"):
        ingest.add_argument(f"--{name}", required=True)
    ingest.add_argument("--key", help="idempotency key")
    rebuild = commands.add_parser("rebuild", help="build the BM25 index anew")
    rebuild.add_argument("--key", help="idempotency key")
    serve = commands.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    for name in ("search", "compare", "compare-rewrite"):
        one = commands.add_parser(name)
        one.add_argument("query", nargs="+", help="one or more queries")
        one.add_argument("--mode", choices=("exact", "ann"), default="exact")
        one.add_argument("--no-rerank", action="store_true")
        one.add_argument("--top-k", type=int, help="final results of each query")
        if name == "search":
            one.add_argument("--rewrite", action="store_true")
    benchmark = commands.add_parser("benchmark", help="quality of the five methods")
    benchmark.add_argument("queries", help="JSON file of evaluation queries")
    benchmark.add_argument("--each", action="store_true", help="time every query by itself")
    return top


def shown(frame: DataFrame, as_json: bool) -> None:
    """Print a small table: results are cut to their top k before."""
    if as_json:
        print("\n".join(r[0] for r in frame.select(F.to_json(F.struct("*"))).collect()))
    else:
        frame.show(1000, truncate=60)


def run(spark: SparkSession, argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    settings = Settings.from_environment(**({"root": given.root} if given.root else {}))
    engine = Engine(spark, settings)
    if given.command == "init":
        print(json.dumps({"generation": engine.init()} | asdict(settings)))
    elif given.command == "status":
        print(json.dumps(engine.status()))
    elif given.command == "doctor":
        found = engine.doctor()
        shown(found, given.json)
        return int(not found.filter("not ok").isEmpty())
    elif given.command == "history":
        shown(engine.ingestions.orderBy("at"), given.json)
    elif given.command == "ingest":
        print(json.dumps(engine.ingest(given.source, given.repo, given.commit, given.language, key=given.key)))
    elif given.command == "rebuild":
        print(json.dumps(engine.rebuild_bm25(given.key)))
    elif given.command == "benchmark":
        shown(engine.benchmark(evaluation_queries(spark, given.queries), given.each).orderBy("method"), given.json)
    elif given.command == "serve":
        with server(engine, given.host, given.port) as made:
            made.serve_forever()
    else:
        queries = spark.createDataFrame(list(enumerate(given.query)), "query_id long, query string")
        options = {"mode": given.mode, "use_reranker": not given.no_rerank} | ({"final_top_k": given.top_k} if given.top_k is not None else {})
        if given.command == "compare":
            shown(engine.compare(queries, options.get("final_top_k")).orderBy("query_id", "chunk_id"), given.json)
        elif given.command == "compare-rewrite":
            shown(engine.compare_rewrite(queries, **options).orderBy("query_id", "position"), given.json)
        else:
            answer = engine.search(queries, use_rewrite=given.rewrite, **options)
            text = preview(F.col("retrieval_text")).alias("preview")
            shown(answer.results.orderBy("query_id", "final_rank").select("query_id", "final_rank", "chunk_id", "source_path", "dense_rank", "bm25_rank", "rrf_rank", "rrf_score", "rerank_score", text), given.json)
            shown(answer.confidence.orderBy("query_id"), given.json)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser().parse_args(argv)  # usage errors come before Spark starts
    spark = SparkSession.builder.appName("tarn").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, argv)
    finally:
        spark.stop()
