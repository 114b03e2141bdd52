"""The engine: tables under one root, ingestion, the BM25 index, search, evaluation, checks.

All searches take a table of queries; one query is a table of one row. Every step is a DataFrame. What
more than one later step reads (the embedded queries, both recalls, the reranked results) is written
once, so no model is called twice for one answer, and results and confidence cannot differ.
"""

from __future__ import annotations

import importlib
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarn.functions import results
from tarn.functions.text import Segmenter
from tarn.operators import blocks, bm25, chunking, dense, evaluation, fusion, lexicon, markdown, quantized, rerank, rewrite, segments, upsert
from tarn.plans.embedding import Embedder, embed, http_embedder, http_scorer
from tarn.plans.settings import Settings
from tarn.shared import written
from tarn.sources.corpus import read_markdown
from tarn.sources.pointers import Generations
from tarn.sources.requests import Requests, request_hash

DOCUMENTS = "id long, source_repo string, source_commit string, source_path string, language string, title string, content_hash string, created_at timestamp"
CHUNKS = (
    "id long, document_id long, chunk_index int, chunker_version string, heading_path array<string>, content_raw string, retrieval_text string, char_count int, content_hash string,"
    " metadata map<string,string>, embedding_model string, embedding_dimensions int, embedding array<float>"
)
#: What an ingestion reports. ``requests`` counts the embedding requests that its documents fill one by one; a
#: service is asked in fewer, which hold texts of several. Without a service
#: embedding counts with the writing, where hashed terms are made.
INGESTED = "documents long, chunks long, embedded long, skipped long, deleted long, requests long, buckets int, generation string, seconds double, timings_ms map<string,double>"
REBUILD = "bm25-rebuild:"
FORMAT_VERSION = 2
METHODS = ("dense_exact", "dense_ann", "bm25", "rrf", "rrf_rerank")


@dataclass(frozen=True)
class Answer:
    """Tables of one search, each keyed by query_id, the milliseconds that its steps took, and what the jobs
    that made them observed: rows, and what the dense search read."""

    queries: DataFrame
    dense: DataFrame
    bm25: DataFrame
    fused: DataFrame
    results: DataFrame
    confidence: DataFrame
    timings: dict[str, float]
    observed: dict[str, int]
    reads: dict[str, int | bool]

    def counts(self) -> dict[str, int]:
        """Rows of the recalls, of their union and of the results; no job is started for them."""
        return {name: self.observed[name] for name in ("dense", "bm25", "union", "results")}


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, embedder: Embedder | None = None, scorer: rerank.Scorer | None = None):
        """Without an embedder or scorer of its own the engine calls the services that the settings name."""
        self.spark, self.settings, self.embedder, self.scorer = spark, settings, embedder, scorer
        key = os.environ.get(settings.key_variable)
        if embedder is None and settings.embedding_url:
            self.embedder = http_embedder(settings.embedding_url, settings.embedding_model, settings.embedding_batch_size, key, settings.timeout_seconds)
        if scorer is None and settings.rerank_url:
            self.scorer = http_scorer(settings.rerank_url, settings.rerank_model, key, settings.timeout_seconds)
        self.tables = Generations(spark, f"{settings.root.rstrip('/')}/tables")
        self.requests = Requests(spark, settings.root)
        self._index = self._lists = self._lexicon = None

    # tables

    def init(self) -> str:
        """Empty tables, unless there are some; the current generation."""
        if self.tables.current() is None:
            self._publish(self.spark.createDataFrame([], DOCUMENTS), self.spark.createDataFrame([], CHUNKS), [])
        return self.tables.current()

    def _manifest(self, name: str) -> dict:
        found = self.tables.manifest(name)
        if found.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"the tables have format {found.get('format_version')}, not {FORMAT_VERSION}")
        return found

    def _publish(self, documents: DataFrame, chunks: DataFrame, touched: list[int], after: str | None = None, guard: Callable[[], None] | None = None) -> str:
        """The next generation: the rows of the ``touched`` buckets in folders of its own, the other buckets in
        the folders that the generation before it has them in. The manifest names the folder of each bucket."""
        name, path = self.tables.new()
        old = self._manifest(after) if after else {"buckets": self.settings.buckets, "parts": {"documents": {}, "chunks": {}}}
        parts = {}
        for table, rows in (("documents", documents), ("chunks", chunks)):
            dealt = rows.withColumn("bucket", upsert.bucket_of_id("id", old["buckets"]))
            dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{path}/{table}")
            mine = {found.partition("=")[2]: name for found in self.tables.files.names(f"{path}/{table}") if found.startswith("bucket=")}
            parts[table] = {b: of for b, of in old["parts"][table].items() if int(b) not in touched} | mine
        self.tables.publish(name, {"format_version": FORMAT_VERSION, "buckets": old["buckets"], "parts": parts, "uses": sorted({of for p in parts.values() for of in p.values()})}, after, guard)
        return name

    def _table(self, table: str, schema: str, buckets: list[int] | None = None, name: str | None = None) -> DataFrame:
        """The current table (or that of the generation ``name``), or those of its buckets; empty where nothing
        was ever published. Reading never writes, and files of other buckets are not looked at."""
        name = name or self.tables.current()
        parts = {} if name is None else self._manifest(name)["parts"][table]
        paths = [f"{self.tables.path(of)}/{table}/bucket={b}" for b, of in sorted(parts.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def sweep(self, keep: int = 2, grace_seconds: float = 86_400.0) -> list[str]:
        """Delete the generations that none of the last ``keep`` ones uses and that are older than the grace
        period, in which a reader or a writer may still work with them; their names."""
        return [name for store in (self.tables, *(Generations(self.spark, f"{self.settings.root.rstrip('/')}/{kind}") for kind in ("bm25", "ann", "lexicon"))) for name in store.sweep(keep, grace_seconds)]

    @property
    def documents(self) -> DataFrame:
        return self._table("documents", DOCUMENTS)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    @property
    def space(self) -> DataFrame:
        """Chunks of the engine's vector space, by chunk_id."""
        s = self.settings
        return dense.in_space(self.chunks, s.embedding_model, s.embedding_dimensions).withColumnRenamed("id", "chunk_id")

    # ingestion

    def ingest(self, source: str, repo: str, commit: str, language: str, root: str | None = None, key: str | None = None) -> dict:
        """Take in a folder of Markdown files, or one, once for each key (by default the request's hash)."""
        s = self.settings
        payload = {"source": source, "repo": repo, "commit": commit, "language": language, "chunker": chunking.VERSION, "limits": asdict(s.limits), "model": s.embedding_model, "dimensions": s.embedding_dimensions}
        return self.requests.once(key or f"ingest-{request_hash(payload)}", payload, lambda guard: self.ingest_texts(read_markdown(self.spark, source, root), repo, commit, language, guard), fenced=True)

    def ingest_texts(self, files: DataFrame, repo: str, commit: str, language: str, guard: Callable[[], None] | None = None) -> dict:
        """Take in a table (source_path, text). Chunks whose text, chunker and vector space are as before
        keep their vectors; others are embedded; those beyond a document's end go."""
        began, s, start = time.monotonic(), self.settings, self.init()
        buckets = self._manifest(start)["buckets"]
        timings: dict[str, float] = {}

        def step(name: str, since: float) -> float:
            timings[name] = 1000 * ((now := time.monotonic()) - since)
            return now

        parsed = markdown.parse_markdown(files.select("source_path", "text"))
        key = {"source_repo": F.lit(repo), "source_commit": F.lit(commit), "language": F.lit(language)}
        parsed = written(parsed.withColumns(key).select(*upsert.DOCUMENT_KEY, "language", "title", F.col("document_hash").alias("content_hash"), "blocks"), "parsed")
        at = step("parse", began)
        fresh = parsed.drop("blocks").withColumn("created_at", F.current_timestamp())
        touched = [r[0] for r in parsed.select(upsert.bucket_of(upsert.DOCUMENT_KEY, buckets)).distinct().collect()]  # numbers of buckets
        held, before = self._table("documents", DOCUMENTS, touched), self._table("chunks", CHUNKS, touched)
        documents = written(
            upsert.upsert(held, fresh, upsert.DOCUMENT_KEY, "id", keep=["created_at"], numbered=lambda added: upsert.with_bucket_ids(added, upsert.DOCUMENT_KEY, "id", upsert.bucket_of(upsert.DOCUMENT_KEY, buckets), buckets, held)),
            "documents",
        )
        ids = documents.select(F.col("id").alias("document_id"), *upsert.DOCUMENT_KEY)
        cut = chunking.chunk_documents(parsed.drop("content_hash"), s.limits).join(ids, list(upsert.DOCUMENT_KEY))
        metadata = F.create_map(*(x for n in ("source_repo", "source_commit", "source_path", "language") for x in (F.lit(n), F.col(n))))
        new = cut.withColumns({"metadata": metadata, "embedding_model": F.lit(s.embedding_model), "embedding_dimensions": F.lit(s.embedding_dimensions)})
        new = new.select("document_id", "chunk_index", "chunker_version", "heading_path", "content_raw", "retrieval_text", "char_count", "content_hash", "metadata", "embedding_model", "embedding_dimensions")
        judged = written(upsert.changed_chunks(new, before), "judged")
        at = step("chunk", at)
        changed = embed(judged.filter("is_changed").drop("is_changed"), "retrieval_text", s.embedding_dimensions, self.embedder)
        at = step("embed", at)
        sizes = ids.join(parsed.select(*upsert.DOCUMENT_KEY), list(upsert.DOCUMENT_KEY)).join(judged.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))
        stays = upsert.without_stale(before, sizes)
        merged = upsert.upsert(stays, changed, upsert.CHUNK_KEY, "id", numbered=lambda added: upsert.with_bucket_ids(added, upsert.CHUNK_KEY, "id", upsert.bucket_of_id("document_id", buckets), buckets, before))
        counts = upsert.totals(upsert.per_document(judged, s.embedding_batch_size)).drop("documents").first().asDict()
        stale = upsert.stale_chunks(before, sizes).count()
        name = self._publish(documents, merged, touched, start, guard)
        documents_taken = parsed.count()
        step("write", at)
        return {"documents": documents_taken, **counts, "deleted": stale, "buckets": len(touched), "generation": name, "seconds": time.monotonic() - began, "timings_ms": timings}

    @property
    def ingestions(self) -> DataFrame:
        """What the completed ingestion requests reported, by key: (key, attempt, at, and the fields of INGESTED). A
        stored result that is none fails the job."""
        done = self.requests.outcomes().filter("status = 'completed'").filter(~F.col("key").startswith(REBUILD))
        return done.select("key", "attempt", "at", results.parsed(F.col("result"), INGESTED, ("documents", "chunks", "embedded", "skipped", "deleted", "seconds"), "ingestion").alias("of")).select("key", "attempt", "at", "of.*")

    @property
    def segmenter(self) -> Segmenter | None:
        """What cuts Han runs; None: pairs of characters."""
        if self.settings.segmenter != "lexicon":
            module, _, function = self.settings.segmenter.partition(":")
            return getattr(importlib.import_module(module), function) if module else None
        store = Generations(self.spark, f"{self.settings.root.rstrip('/')}/lexicon")
        name = store.current()
        if name is None:
            raise bm25.IndexMissing(f"no lexicon under {self.settings.root}")
        if self._lexicon is None or self._lexicon[0] != name:
            self._lexicon = name, lexicon.load(self.spark, f"{store.path(name)}/words")
        return self._lexicon[1]

    def rebuild_lexicon(self, **options) -> dict:
        """Build the dictionary of Han words anew from the engine's chunks and make it current. An index that
        was built with another one no longer fits: rebuild it next. ``options`` are those of ``lexicon.build``."""
        store = Generations(self.spark, f"{self.settings.root.rstrip('/')}/lexicon")
        name, path = store.new()
        lexicon.build(self.space, **options).write.parquet(f"{path}/words")
        store.publish(name, {"longest": lexicon.LONGEST})
        return {"generation": name, "words": self.spark.read.parquet(f"{path}/words").filter(F.length("word") > 1).count()}

    def rebuild_bm25(self, key: str | None = None) -> dict:
        """Index the engine's vector space anew and make it current; with a key, once."""
        s = self.settings

        def work() -> dict:
            began = time.monotonic()
            name = bm25.publish(self.space, f"{s.root}/bm25", s.embedding_model, s.embedding_dimensions, segmenter=self.segmenter, source=self.tables.current() or "")
            return {"generation": name, "chunks": self.space.count(), "seconds": time.monotonic() - began}

        self._index = None
        if key is None:
            return work()
        return self.requests.once(f"{REBUILD}{key}", {"operation": "bm25-rebuild", "model": s.embedding_model, "dimensions": s.embedding_dimensions, "root": s.root}, work)

    def update_bm25(self) -> dict:
        """Bring the index up to the current tables: a segment with what changed since it was built, read from
        the buckets that differ only. Where there is no fitting index, or its tables are gone, all anew."""
        s, began, now = self.settings, time.monotonic(), self.tables.current()
        try:
            name, manifest = bm25.current(self.spark, f"{s.root}/bm25", s.embedding_model, s.embedding_dimensions, self.segmenter)
            sides = [self._manifest(of) for of in (manifest["source"], now)]
        except (bm25.IndexMissing, bm25.IndexMismatch, ValueError):
            return self.rebuild_bm25() | {"added": None, "removed": None}
        parts = [side["parts"]["chunks"] for side in sides]
        if any(not self.tables.files.exists(f"{self.tables.path(of)}/chunks/bucket={b}") for b, of in parts[0].items() if parts[1].get(b) != of):
            return self.rebuild_bm25() | {"added": None, "removed": None}
        touched = [int(b) for b in {*parts[0], *parts[1]} if parts[0].get(b) != parts[1].get(b)]
        old, new = (dense.in_space(self._table("chunks", CHUNKS, touched, of), s.embedding_model, s.embedding_dimensions).select(F.col("id").alias("chunk_id"), "retrieval_text") for of in (manifest["source"], now))
        same = ["chunk_id", "retrieval_text"]
        added, removed = written(new.join(old, same, "left_anti"), "added"), written(old.join(new, same, "left_anti"), "removed")
        counts = {"added": added.count(), "removed": removed.count()}
        if any(counts.values()):
            name = bm25.grow(added, removed, f"{s.root}/bm25", s.embedding_model, s.embedding_dimensions, segmenter=self.segmenter, source=now)
            self._index = None
        return {"generation": name, "chunks": self.space.count(), "seconds": time.monotonic() - began} | counts

    def reload_bm25(self) -> segments.Segments:
        self._index = bm25.load(self.spark, f"{self.settings.root}/bm25", self.settings.embedding_model, self.settings.embedding_dimensions, self.segmenter)
        return self._index

    def aliases(self) -> dict[str, str]:
        """The alias dictionary: the settings' file, else the one that ships with the engine."""
        if not self.settings.alias_path:
            return rewrite.ALIASES
        text = self.tables.files.read(self.settings.alias_path)
        if text is None:
            raise rewrite.BadAliases(f"there is no alias dictionary at {self.settings.alias_path}")
        return rewrite.load_aliases(text)

    # search

    def search(self, queries: DataFrame, mode: str = "exact", use_reranker: bool = True, use_rewrite: bool = False, **changes: int) -> Answer:
        """Answer a table (query_id, query). ``changes`` replace top-k settings for this search."""
        s = self.settings
        if mode not in ("exact", "ann"):
            raise ValueError("mode must be exact or ann")
        s = Settings(**asdict(s) | changes)
        if not queries.filter(F.trim(F.coalesce("query", F.lit(""))) == "").isEmpty():
            raise ValueError("query must not be empty")
        timings: dict[str, float] = {}

        observed: dict[str, int] = {}
        reads: dict[str, int | bool] = {"uses_index": False}

        def counted(name: str, table: DataFrame) -> DataFrame:
            """The table, written; its rows are counted by the job that writes it."""
            seen = Observation(f"{name} {uuid.uuid4().hex}")
            table = written(table.observe(seen, F.count(F.lit(1)).alias("rows")), name)
            observed[name] = seen.get["rows"]
            return table

        def step(name: str, work: Callable[[], DataFrame], rows: str | None = None) -> DataFrame:
            began = time.monotonic()
            table = counted(rows or name, work())
            timings[name] = 1000 * (time.monotonic() - began)
            return table

        rewritten = rewrite.rewrite_queries(queries, self.aliases() if use_rewrite else None, use_rewrite)
        asked = step("embedding", lambda: embed(rewritten, "effective_query", s.embedding_dimensions, self.embedder))
        space, index = self.space, self._index or self.reload_bm25()
        near = step("dense", lambda: self._dense(asked, space, mode, s, reads))
        sparse = step("bm25", lambda: blocks.bm25_topk(asked, index, s.bm25_top_k, "effective_query", segmenter=self.segmenter))
        fused = fusion.reciprocal_rank_fusion(near.select("query_id", "rank", "chunk_id", F.col("cosine_similarity").alias("score")), sparse, s.rrf_constant)

        def candidates() -> DataFrame:
            """The head of the fused ranking with its evidence."""
            nonlocal fused
            fused = counted("union", fused)
            head = written(fused.filter(F.col("rrf_rank") <= (s.rerank_top_k if use_reranker else s.final_top_k)), "head")
            return head.join(self._evidence(head), "chunk_id").join(asked.select("query_id", F.col("effective_query").alias("query")), "query_id")

        if use_reranker:
            results = step("rerank", lambda: rerank.final_topk(rerank.rerank(candidates(), s.rerank_top_k, self.scorer), s.final_top_k, "rerank_rank"), "results")
        else:
            blank = {"rerank_score": F.lit(None).cast("double"), "rerank_rank": F.lit(None).cast("int")}
            results = step("fusion", lambda: rerank.final_topk(candidates().withColumns(blank), s.final_top_k, "rrf_rank"), "results")
        timings["total"] = sum(timings.values())
        return Answer(asked.drop("embedding"), near, sparse, fused, results, rerank.confidence(queries, results, s.low_confidence_threshold, use_reranker), timings, observed, reads)

    def _evidence(self, ranked: DataFrame) -> DataFrame:
        """Chunks with their documents from the buckets that ``ranked`` names by its chunk ids, no others."""
        s, name = self.settings, self.tables.current()
        buckets = self._manifest(name)["buckets"] if name else 1
        wanted = [r[0] for r in ranked.select(upsert.bucket_of_id("chunk_id", buckets)).distinct().collect()]
        chunks = dense.in_space(self._table("chunks", CHUNKS, wanted), s.embedding_model, s.embedding_dimensions).withColumnRenamed("id", "chunk_id")
        documents = self._table("documents", DOCUMENTS, wanted).select(F.col("id").alias("document_id"), *upsert.DOCUMENT_KEY, "language", "title")
        return chunks.drop("embedding", "content_hash").join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi").join(documents, "document_id")

    def _dense(self, asked: DataFrame, space: DataFrame, mode: str, s: Settings, reads: dict[str, int | bool]) -> DataFrame:
        if mode == "exact":
            return dense.exact_topk(asked, space, s.dense_top_k, s.embedding_dimensions)
        found = quantized.search(asked, self.lists(), s.dense_top_k, s.embedding_dimensions, s.nprobe or None)
        reads |= {"uses_index": True, "codes": found.codes, "vectors": found.vectors, "lists": found.lists}
        return found.rows

    def lists(self) -> quantized.Index:
        """The approximate index of the current tables and the engine's vector space: read where there is
        one, else built and published beside the tables for every process to read."""
        s = self.settings
        wanted = {"kind": "quantized", "tables": self.tables.current(), "model": s.embedding_model, "dimensions": s.embedding_dimensions, "lists": s.lists}
        store = Generations(self.spark, f"{s.root.rstrip('/')}/ann")
        name = store.current()
        if name is None or any(store.manifest(name).get(k) != v for k, v in wanted.items()):
            name, path = store.new()
            quantized.build(self.space, s.embedding_dimensions, s.lists or None, path=path)
            store.publish(name, wanted)
            self._lists = None
        if self._lists is None or self._lists[0] != name:
            self._lists = name, quantized.load(self.spark, store.path(name))
        return self._lists[1]

    def compare(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Ranks of the chunks among the first k of exact, approximate and BM25 recall and of their fusion,
        side by side: query_id, chunk_id, exact_rank, ann_rank, bm25_rank, rrf_rank."""
        k = self.settings.final_top_k if k is None else k
        exact, near = self.search(queries, use_reranker=False), self.search(queries, "ann", use_reranker=False)
        sides = {"exact_rank": exact.dense, "ann_rank": near.dense, "bm25_rank": exact.bm25, "rrf_rank": exact.fused.select("query_id", "chunk_id", F.col("rrf_rank").alias("rank"))}
        both = None
        for name, side in sides.items():
            one = side.filter(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias(name))
            both = one if both is None else both.join(one, ["query_id", "chunk_id"], "full_outer")
        return both

    def compare_rewrite(self, queries: DataFrame, **options) -> DataFrame:
        """The final rankings without and with rewriting, side by side."""
        sides = [self.search(queries, use_rewrite=on, **options).results.select("query_id", "chunk_id", F.col("final_rank").alias("rank")) for on in (False, True)]
        return rewrite.ranking_diff(*sides)

    # checks

    def benchmark(self, queries: DataFrame, each: bool = False) -> DataFrame:
        """Quality and latency (mean_ms, p95_ms) of the five methods on evaluation queries, a small labelled
        set. With ``each``, every query is asked and timed by itself; else a method's queries are one
        batch, and its time is shared out over them, so that the percentile equals the mean."""
        s, hits, times = self.settings, [], []
        wide = {"dense_top_k": max(10, s.dense_top_k), "bm25_top_k": max(10, s.bm25_top_k), "rerank_top_k": max(10, s.rerank_top_k), "final_top_k": 10}
        ids = [r[0] for r in queries.select("query_id").collect()]
        batches = [[i] for i in ids] if each else [ids]
        evidence = self.space.select("chunk_id", "document_id", "heading_path").join(self.documents.select(F.col("id").alias("document_id"), "source_path"), "document_id").drop("document_id")
        self.lists()  # built before any method is timed
        for method in METHODS:
            for batch in batches:
                began = time.monotonic()
                answer = self.search(queries.filter(F.col("query_id").isin(batch)).select("query_id", "query"), "ann" if method == "dense_ann" else "exact", method == "rrf_rerank", **wide)
                took = 1000 * (time.monotonic() - began)
                if method in ("dense_exact", "dense_ann", "bm25"):  # one side's steps only
                    took = answer.timings["embedding"] * (method != "bm25") + answer.timings["bm25" if method == "bm25" else "dense"]
                ranked = {"dense_exact": answer.dense, "dense_ann": answer.dense, "bm25": answer.bm25}.get(method)
                ranked = answer.results.withColumn("rank", F.col("final_rank")) if ranked is None else ranked
                hits.append(ranked.filter("rank <= 10").select("query_id", "rank", "chunk_id", F.lit(method).alias("method")))
                times += [(method, took / len(batch))] * len(batch)
        union = hits[0]
        for one in hits[1:]:
            union = union.unionByName(one)
        of = evaluation.relevant(F.col("source_path"), F.col("heading_path"), F.col("relevant_path_contains"), F.col("relevant_heading_contains"))
        judged = union.join(evidence, "chunk_id").join(queries.drop("query"), "query_id").withColumn("is_relevant", of)
        quality = evaluation.quality(evaluation.first_relevant_rank(queries, judged, ["method"]), ["method"])
        return quality.join(evaluation.latency(self.spark.createDataFrame(times, "method string, latency_ms double"), ["method"]), "method", "left")

    def status(self) -> dict:
        indexes = {"bm25": Generations(self.spark, f"{self.settings.root}/bm25").current(), "ann": Generations(self.spark, f"{self.settings.root.rstrip('/')}/ann").current()}
        return {"generation": self.tables.current(), "indexes": indexes, "documents": self.documents.count(), "chunks": self.chunks.count(), "spaces": [tuple(r) for r in self.spaces().collect()]}

    def spaces(self) -> DataFrame:
        return self.chunks.select("embedding_model", "embedding_dimensions").distinct().orderBy("embedding_model", "embedding_dimensions")

    def doctor(self) -> DataFrame:
        """(check, ok, detail): what a search needs. A failure is named by its kind only."""

        def attempt(check: str, work) -> tuple[str, bool, str]:
            try:
                return check, True, str(work())
            except Exception as error:  # noqa: BLE001  any failure is a finding
                return check, False, type(error).__name__

        def published() -> str:
            if (name := self.tables.current()) is None:
                raise LookupError("tables")
            return name

        def one_space() -> str:
            found = self.spaces().collect()
            if [tuple(r) for r in found] != [(self.settings.embedding_model, self.settings.embedding_dimensions)]:
                raise LookupError("vector space")
            return "one vector space"

        probe = self.spark.createDataFrame([(0, "probe", "probe")], "query_id long, query string, retrieval_text string")
        checks = [
            attempt("tables", published),
            attempt("embedding", lambda: len(embed(probe, "query", self.settings.embedding_dimensions, self.embedder).first()["embedding"])),
            attempt("rerank", lambda: rerank.rerank(probe.withColumn("rrf_rank", F.lit(1)), 1, self.scorer).count()),
            attempt("bm25", lambda: self.reload_bm25().corpus_stats.first()["n"]),
            attempt("vector space", one_space),
        ]
        return self.spark.createDataFrame(checks, "check string, ok boolean, detail string")
