"""Terms, Markdown blocks and chunks."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions.html_markdown import html_to_markdown
from tarn.functions.text import preview, retrieval_text, terms
from tarn.operators import chunking, markdown
from tarn.operators.chunking import ChunkLimits


def test_terms(spark):
    rows = spark.createDataFrame([("OAuth2PasswordBearer HTTP 422 request_body foo.bar 3.14 éeux!",), ("…?!",), (None,), ("请求体 x 字",)], "t string")
    got = [r[0] for r in rows.select(terms(F.col("t"))).collect()]
    assert got == [["oauth2passwordbearer", "http", "422", "request_body", "foo.bar", "3.14", "eux"], [], [], ["请求", "求体", "x", "字"]]


PAGE = """---
title: FastAPI 教程
tags:
  - fastapi
---

# 主标题

导言。

## 安全

### OAuth2

OAuth2 内容。

- 字段一
- 字段二

```python
# no heading
class Item: pass
```

## 依赖项

Text one
goes on

> quoted
lazy

    indented code

<div>
html
</div>

***

Setext
------

1. one

   more of one
2. two

after

# 附录

[link]: http://example.com "only a definition"
end
"""


def parsed(spark, *pages):
    return markdown.parse_markdown(spark.createDataFrame([(f"d/p{i}.md", p) for i, p in enumerate(pages)], "source_path string, text string"))


def test_markdown_blocks(spark):
    row = parsed(spark, PAGE).first()
    assert (row["title"], row["first_h1"]) == ("FastAPI 教程", "主标题")
    assert json.loads(row["frontmatter"]) == {"title": "FastAPI 教程", "tags": ["fastapi"]}
    got = [(b["kind"], b["text"], list(b["heading_path"])) for b in row["blocks"]]
    assert got == [
        ("paragraph", "导言。", ["主标题"]),
        ("paragraph", "OAuth2 内容。", ["主标题", "安全", "OAuth2"]),
        ("list", "- 字段一\n- 字段二", ["主标题", "安全", "OAuth2"]),
        ("code", "```python\n# no heading\nclass Item: pass\n```", ["主标题", "安全", "OAuth2"]),
        ("paragraph", "Text one\ngoes on", ["主标题", "依赖项"]),
        ("paragraph", "> quoted\nlazy", ["主标题", "依赖项"]),
        ("code", "    indented code", ["主标题", "依赖项"]),
        ("paragraph", "<div>\nhtml\n</div>", ["主标题", "依赖项"]),
        ("list", "1. one\n\n   more of one\n2. two", ["主标题", "Setext"]),
        ("paragraph", "after", ["主标题", "Setext"]),
        ("paragraph", "end", ["附录"]),
    ]
    assert [b["section_root"] for b in row["blocks"]][-1] == "附录"


def test_line_ends_and_titles(spark):
    rows = parsed(spark, "# A\r\n\r\ntext\r\n", "---\ntitle: 12\nname: ' N '\n---\nx", "---\ntitle: ''\n---\n", "", "preamble").collect()
    assert [b["text"] for b in rows[0]["blocks"]] == ["text"]
    assert [r["title"] for r in rows] == [None, "N", None, None, None]
    assert rows[4]["blocks"][0]["section_root"] == "p4" and rows[4]["blocks"][0]["heading_path"] == []


def blocks_frame(spark, texts, title=None):
    blocks = [("paragraph", t, [] if h is None else [h], "r") for h, t in texts]
    return spark.createDataFrame([(1, title, blocks)], f"doc long, title string, blocks array<{markdown.BLOCK}>")


def test_pack_without_overlap(spark):
    got = chunking.chunk_documents(blocks_frame(spark, [(None, "AAAAAA"), (None, "BBBBBB")]), ChunkLimits(5, 10, 0)).orderBy("chunk_index").collect()
    assert [r["content_raw"] for r in got] == ["AAAAAA", "BBBBBB"]


def test_retrieval_text(spark):
    row = spark.range(1).select(retrieval_text(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit("x")).alias("a"), retrieval_text(F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit("x")).alias("b")).first()
    assert row["a"] == "[文档：T]\n[章节：A / B]\nx" and row["b"] == "[章节：（文档正文）]\nx"


@pytest.mark.parametrize("limits", [(0, 10, 0), (10, 5, 0), (10, 20, 10), (10, 20, -1)])
def test_bad_limits(limits):
    with pytest.raises(ValueError):
        ChunkLimits(*limits)


def packed(texts, target, most, overlap):
    """One block after the other, in plain Python."""
    done, current, section = [], "", None
    for heading, text in texts:
        if heading != section:
            done += [(section, current)] * bool(current)
            current, section = "", heading
        if len(text) > most:
            done += [(section, current)] * bool(current)
            current, at = "", 0
            while True:
                done.append((section, text[at : at + most]))
                if at + most >= len(text):
                    break
                at += most - overlap
        elif not current:
            current = text
        elif len(current) < target and len(current) + 2 + len(text) <= most:
            current += "\n\n" + text
        else:
            done.append((section, current))
            seeded = current[-overlap:] + "\n\n" + text if overlap else text
            current = seeded if len(seeded) <= most else text
    return done + [(section, current)] * bool(current)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.text("xyzü", min_size=1, max_size=60)), max_size=12), st.sampled_from([(20, 30, 5), (8, 40, 0), (30, 30, 29)]))
def test_pack_equals_loop(spark, texts, limits):
    got = chunking.chunk_documents(blocks_frame(spark, texts), ChunkLimits(*limits)).orderBy("chunk_index").collect()
    assert [(r["heading_path"][0], r["content_raw"]) for r in got] == packed(texts, *limits)
    assert all(r["char_count"] == len(r["content_raw"]) for r in got)


def test_html_to_markdown():
    got = html_to_markdown("<head><title>T</title><style>x</style></head><h1>A</h1><p>one <b>two</b></p><ul><li>x<li>y</ul><script>no</script><h6>B</h6>")
    assert got == "## A\n\none **two**\n\n- x\n- y\n\n###### B"
    assert html_to_markdown("<title>T</title><p>x") == "## T\n\nx"


def test_preview(spark):
    row = spark.range(1).select(preview(F.lit(" a \n b ")).alias("a"), preview(F.lit("x" * 200)).alias("b")).first()
    assert row["a"] == "a b" and row["b"] == "x" * 99 + "…"


def test_references_that_a_length_limit_cut_off():
    page = "<title>a &lt; b &amp;&amp</title><a href='?x=1&amp;copy=2'>&nosuch; &#65; &#x42; &ampx; AT&T &amp;lt; & &copy;</a>"
    assert html_to_markdown(page, closed=True) == "## a < b &&amp\n\n[&nosuch; A B &ampx; AT&T &lt; & ©](?x=1&copy=2)"
    assert html_to_markdown(page).startswith("## a < b &&\n")


def test_markdown_is_scanned_in_slices(spark):
    import pyarrow as pa

    texts = ["", "x" * 700_000, "ä" * 400_000, None, "# a\n\nb", "y" * 3_000_000, "z"]
    assert list(markdown._slices(pa.array(["" if t is None else t for t in texts]))) == [(0, 2), (2, 5), (5, 6), (6, 7)]
    rows = spark.createDataFrame([(i, f"p/{i}.md", t) for i, t in enumerate(texts)], "id int, source_path string, text string").coalesce(1)
    got = {r["id"]: r for r in markdown.parse_markdown(rows).collect()}
    assert [[b["text"] for b in got[i]["blocks"]] for i in range(7)] == [[], [texts[1]], [texts[2]], [], ["b"], [texts[5]], ["z"]]
    assert got[4]["first_h1"] == "a" and got[4]["blocks"][0]["section_root"] == "a" and got[6]["blocks"][0]["section_root"] == "6"
