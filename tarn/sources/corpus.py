"""Files of a corpus as tables: Markdown trees, EPUB books, evaluation queries."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.html_markdown import html_to_markdown

LANGUAGES = ("zh", "en")


def read_markdown(spark: SparkSession, source: str, root: str | None = None) -> DataFrame:
    """(source_path, text) of the Markdown files below a folder, or of one file. ``source_path`` is
    relative to ``root`` (the folder, or the file's folder); a file outside it raises, and so does a
    file of another kind."""
    if re.search(r"\.[^/.]+$", source) and not re.search(r"(?i)\.md$", source):
        raise ValueError(f"not a Markdown file: {source}")
    single = source.lower().endswith(".md")
    root = (root or (posixpath.dirname(source) if single else source)).rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").text(source, wholetext=True)
    return _relative(files, root)


def stream_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as a stream: files that come into the folder."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").text(folder, wholetext=True)
    return _relative(files, folder.rstrip("/"))


def _relative(files: DataFrame, root: str) -> DataFrame:
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    base = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "", root) + "/"
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    outside = F.raise_error(F.concat(F.lit(f"outside {root}: "), path)).cast("string")
    return files.select(F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(outside).alias("source_path"), F.col("value").alias("text"))


def count_by_language(spark: SparkSession, root: str) -> DataFrame:
    """(language, n_files) of the Markdown files below ``docs/<language>/``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    return files.select(F.regexp_extract("path", r"/docs/([a-z]+)/", 1).alias("language")).filter(F.col("language").isin(*LANGUAGES)).groupBy("language").agg(F.count("*").alias("n_files"))


def source_directory(root: str, language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {', '.join(LANGUAGES)}")
    return f"{root.rstrip('/')}/docs/{language}/docs"


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_path_contains, relevant_heading_contains, category) of a JSON list.
    Blank texts, a query without hints and one that stands there twice raise."""
    of = "query string, relevant_path_contains array<string>, relevant_heading_contains array<string>, category string"
    rows = spark.read.schema(of).option("multiLine", True).option("mode", "FAILFAST").json(path).collect()  # written by hand
    seen = set()
    for r in rows:
        hints = [*(r["relevant_path_contains"] or ()), *(r["relevant_heading_contains"] or ())]
        if not (r["query"] or "").strip() or not (r["category"] or "").strip() or not hints or not all((h or "").strip() for h in hints):
            raise ValueError("an evaluation query must have a text, a category and at least one hint, none blank")
        if r["query"] in seen:
            raise ValueError(f"evaluation query {r['query']!r} stands there twice")
        seen.add(r["query"])
    if not rows:
        raise ValueError("there are no evaluation queries")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"query_id long, {of}")


def _book(content: bytes) -> list[tuple[int, str, str, str]]:
    """(place, chapter's name, front matter as JSON, Markdown) of an EPUB's reading order."""
    name = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package_at = next(e.get("full-path") for e in container.iter() if name(e) == "rootfile")
        package = ElementTree.fromstring(book.read(package_at))
        about = {name(e): (e.text or "").strip() for e in reversed(list(package.iter())) if name(e) in ("title", "creator", "language", "publisher", "date") and (e.text or "").strip()}
        items = {e.get("id"): e for e in package.iter() if name(e) == "item"}
        out = []
        for place, ref in enumerate(e for e in package.iter() if name(e) == "itemref"):
            item = items.get(ref.get("idref"))
            if item is None or "nav" in (item.get("properties") or "").split() or "html" not in (item.get("media-type") or "html"):
                continue
            at = posixpath.normpath(posixpath.join(posixpath.dirname(package_at), unquote(item.get("href"))))
            text = html_to_markdown(book.read(at).decode("utf-8", "replace"))
            if text.strip():
                out.append((place, posixpath.basename(at), json.dumps(about, ensure_ascii=False), text))
    return out


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, chapter, name, frontmatter, text): the chapters of EPUB books as Markdown."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for books in batches:
            rows = [(p, *c) for p, content in zip(books["path"], books["content"]) for c in _book(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "chapter", "name", "frontmatter", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInPandas(work, "path string, chapter int, name string, frontmatter string, text string")
