"""Markdown documents to blocks with heading paths.

Only top-level blocks matter to chunking, so each line is told apart by its first characters. The scan
is the one part in Python, as a block's end depends on the lines before it; front matter, titles,
hashes and everything after are expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import normalize_newlines, sha256

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}>")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))(?:([ \t]+)(?=\S)|[ \t]*$)")
_INDENTED = re.compile(r"(?: {4}| {0,3}\t)")
_DEFINITION = re.compile(r" {0,3}\[(?!\s*\])[^\[\]]+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
# CommonMark's HTML block starts with the ends they wait for, and its block-level names.
_HTML_STARTS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
)
_HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset"
    " h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead"
    " title tr track ul"
)
_HTML_BLOCK = re.compile(rf" {{0,3}}</?(?:{_HTML_NAMES.replace(' ', '|')})(?:\s|/?>|$)", re.I)
_ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
_HTML_ALONE = re.compile(rf" {{0,3}}(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")

BLOCK = "struct<kind:string,text:string,heading_path:array<string>,section_root:string>"
_SCANNED = pa.struct([("first_h1", pa.string()), ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("section_root", pa.string())])))])
#: Texts are scanned, and their blocks handed on, in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges with about SLICE_BYTES of text each."""
    size, i = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield i, j
        i = j


def _starts_block(line: str) -> bool:
    """Whether the line ends a paragraph by starting something else."""
    item = _ITEM.match(line)
    return bool(
        _ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML_BLOCK.match(line) or any(s.match(line) for s, _ in _HTML_STARTS)
        or item and item[5] and (not item[3] or item[3] == "1")
    )


def _html_end(lines: list[str], i: int, in_paragraph: bool = False) -> int | None:
    for start, end in _HTML_STARTS:
        if start.match(lines[i]):
            return next((j + 1 for j in range(i, len(lines)) if end.search(lines[j])), len(lines))
    if _HTML_BLOCK.match(lines[i]) or not in_paragraph and _HTML_ALONE.match(lines[i]):
        return next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
    return None


def _width(space: str) -> int:
    return len(space.expandtabs(4))


def _fence_end(lines: list[str], i: int, fence: str) -> int:
    closing = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
    return next((j + 1 for j in range(i + 1, len(lines)) if closing.match(lines[j])), len(lines))


def _list_end(lines: list[str], i: int) -> int:
    """The line after a list. Lines belong to it if indented to an item's text, if they are items with
    the same mark, or if they continue an item's paragraph."""
    mark, text_at, j, lazy, blank, fence = None, 0, i, False, False, None
    while j < len(lines):
        line = lines[j]
        indent = _width(line) - _width(line.lstrip(" \t")) if line.strip() else 0
        indent = _width(line[: len(line) - len(line.lstrip(" \t"))])
        item = _ITEM.match(line)
        if not line.strip():
            blank, lazy = True, False
        elif fence and indent >= text_at:
            if re.match(rf"{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line.strip()):
                fence = None
            blank = False
        elif item and not _RULE.match(line) and (mark is None or (item[4] or item[2]) == mark) and (mark is None or indent < text_at):
            mark = item[4] or item[2]
            text_at = _width(item[1] + item[2] + item[5]) if item[5] and _width(item[5]) < 5 else len(item[1] + item[2]) + 1
            lazy, blank, fence = bool(item[5]), False, None
        elif mark is not None and indent >= text_at:
            opened = _FENCE.match(line.strip())
            fence = (opened[1] or opened[2]) if opened else None
            lazy, blank = not opened, False
        elif lazy and not blank and not _starts_block(line):
            pass
        else:
            break
        j += 1
    while j > i and not lines[j - 1].strip():
        j -= 1
    return j


def _quote_end(lines: list[str], i: int) -> int:
    lazy, j = False, i
    while j < len(lines):
        if _QUOTE.match(lines[j]):
            inner = _QUOTE.sub("", lines[j], count=1).removeprefix(" ")
            lazy = bool(inner.strip()) and not (_ATX.match(inner) or _FENCE.match(inner) or _RULE.match(inner) or _INDENTED.match(inner) and not lazy)
        elif not (lazy and lines[j].strip() and not _starts_block(lines[j])):
            break
        j += 1
    return j


def top_level(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, level, source) of each top-level block in order: heading (with its level and its own
    text), paragraph, list or code."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if _INDENTED.match(line):
            j = i + 1
            while j < len(lines) and (_INDENTED.match(lines[j]) or not lines[j].strip()):
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            kind = "code"
        elif fence := _FENCE.match(line):
            kind, j = "code", _fence_end(lines, i, fence[1] or fence[2])
        elif heading := _ATX.match(line):
            yield "heading", len(heading[1]), (heading[2] or "").strip()
            i += 1
            continue
        elif _RULE.match(line):
            i += 1
            continue
        elif _QUOTE.match(line):
            kind, j = "paragraph", _quote_end(lines, i)
        elif _ITEM.match(line):
            kind, j = "list", _list_end(lines, i)
        elif end := _html_end(lines, i):
            kind, j = "paragraph", end
        else:
            kind, j, level = "paragraph", i + 1, 0
            while j < len(lines) and lines[j].strip():
                if underline := _UNDERLINE.match(lines[j]):
                    level = 1 if underline[1][0] == "=" else 2
                    break
                if _starts_block(lines[j]):
                    break
                j += 1
            source = "\n".join(lines[i:j])
            while found := _DEFINITION.match(source):
                source = source[found.end() :]
            if level and source.strip():
                yield "heading", level, "\n".join(x.strip() for x in source.split("\n")).strip()
                i = j + 1
                continue
            if source.strip():
                yield kind, 0, source.strip("\n")
            i = j
            continue
        yield kind, 0, "\n".join(lines[i:j]).strip("\n")
        i = j


def blocks_of(body: str, root: str) -> tuple[str | None, list[dict]]:
    """(first level-one heading, blocks with the headings above them)."""
    first, path, out = None, {}, []
    for kind, level, source in top_level(body):
        if kind == "heading":
            path = {k: v for k, v in path.items() if k < level} | {level: source}
            if level == 1:
                first, root = source if first is None else first, source
        elif source:
            out.append({"kind": kind, "text": source, "heading_path": [path[k] for k in sorted(path)], "section_root": root})
    return first, out


_FRONT = r"(?s)^\s*---[ \t]*\n(.*?)(?:\n|^)---[ \t]*(?:\n|$)(.*)$"


def front_matter(text: Column) -> Column:
    """JSON of the YAML mapping at the top of a text; ``{}`` where there is none."""

    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import yaml

        def one(raw: str | None) -> str:
            got = yaml.safe_load(raw) if raw else None
            return json.dumps(got if isinstance(got, dict) else {}, ensure_ascii=False, default=str)

        for raw in batches:
            yield raw.map(one)

    return work(F.regexp_extract(text, _FRONT, 1))


def parse_markdown(documents: DataFrame, text: str = "text", source_path: str = "source_path") -> DataFrame:
    """``documents`` with title (first non-blank string of the front matter's ``title`` and ``name``,
    else null), first_h1, frontmatter (JSON), document_hash (of the whole text with LF line ends) and
    blocks. Null text counts as empty."""

    @F.arrow_udf(f"struct<first_h1:string,blocks:array<{BLOCK}>>")
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, roots in batches:
            for i, j in _slices(bodies):
                parsed = [blocks_of(b, r) for b, r in zip(bodies[i:j].to_pylist(), roots[i:j].to_pylist())]
                yield pa.array([{"first_h1": h, "blocks": b} for h, b in parsed], _SCANNED)

    whole = normalize_newlines(F.coalesce(F.col(text), F.lit("")))
    body = F.when(whole.rlike(_FRONT), F.regexp_extract(whole, _FRONT, 2)).otherwise(whole)
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(F.col(source_path), F.lit("")), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    rows = documents.withColumn("frontmatter", front_matter(whole)).withColumn("document_hash", sha256(whole)).withColumn("__scan", scan(body, stem))
    front = F.from_json("frontmatter", "map<string,string>")
    is_string = lambda key: F.get_json_object("frontmatter", f"$.{key}").isNotNull() & F.col("frontmatter").rlike(rf'"{key}": "')
    titles = [F.when(is_string(k) & (F.trim(front[k]) != ""), F.trim(front[k])) for k in ("title", "name")]
    return rows.withColumn("title", F.coalesce(*titles)).withColumn("first_h1", F.col("__scan.first_h1")).withColumn("blocks", F.col("__scan.blocks")).drop("__scan")
