"""Continuous ingestion: files that arrive in a folder are taken in batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tarn.plans.engine import Engine
from tarn.sources.corpus import stream_markdown


def ingest_stream(engine: Engine, folder: str, checkpoint: str, repo: str, commit: str, language: str, rebuild: bool = True, **trigger) -> StreamingQuery:
    """Start a query that takes in each batch of new Markdown files and, with ``rebuild``, brings the
    index up to them by a segment of what changed.

    A batch is one ingestion under the key of its number, so a batch that is run again after a failure
    changes nothing. ``trigger`` is that of ``DataStreamWriter.trigger``; by default the files that are
    there are taken in and the query ends."""

    def take(files: DataFrame, number: int) -> None:
        if files.isEmpty():
            return
        payload = {"stream": folder, "batch": number, "repo": repo, "commit": commit, "language": language}
        engine.requests.once(f"stream:{folder}:{number}", payload, lambda guard: engine.ingest_texts(files, repo, commit, language, guard), fenced=True)
        if rebuild:
            engine.update_bm25()

    files = stream_markdown(engine.spark, folder)
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
