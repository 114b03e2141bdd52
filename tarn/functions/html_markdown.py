"""HTML pages to Markdown with ATX headings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that leave nothing (images too, which have no end).
_DROPPED = ("script", "style", "nav", "noscript", "svg")
_BLOCKS = frozenset("p div section article header footer main aside ul ol table tr blockquote pre figure figcaption dl dt dd hr body form fieldset address".split())
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+);|([A-Za-z][A-Za-z0-9]*;))?")


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.gone, self.in_title, self.pre, self.headings, self.lists, self.links = 0, False, 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.gone += 1
        elif self.gone or tag == "img":
            return
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.headings += 1
            self.out.append("\n\n" + "#" * min(6, int(tag[1]) + 1) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "li":
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{self._count()}. " if self.lists and self.lists[-1] else "- "))
        elif tag in ("ul", "ol"):
            self.out.append("" if self.lists else "\n\n")
            self.lists.append(1 if tag == "ol" else 0)
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag in ("b", "strong", "i", "em", "code") and not self.pre:
            self.out.append({"b": "**", "strong": "**", "code": "`"}.get(tag, "*"))
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def _count(self) -> int:
        self.lists[-1] += 1
        return self.lists[-1] - 1

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.gone = max(0, self.gone - 1)
        elif self.gone:
            return
        elif tag == "title":
            self.in_title = False
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("" if self.lists else "\n\n")
        elif tag in ("b", "strong", "i", "em", "code") and not self.pre:
            self.out.append({"b": "**", "strong": "**", "code": "`"}.get(tag, "*"))
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.gone:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def _closed_only(html: str) -> str:
    """The page with every ampersand escaped that does not begin a reference closed by a semicolon."""
    return _REFERENCE.sub(lambda m: m[0] if m[0] != "&" and (m[1] is None or m[1] in html5) else "&amp;" + m[0][1:], html)


def html_to_markdown(html: str, closed: bool = False) -> str:
    """Markdown of a page: headings one level down (the sixth stays), a second-level heading of the
    title where the page has none, no more than one blank line in a row. With ``closed``, character references
    count only with their semicolon, as in XHTML (``&amp`` cut off by a length limit stays as it is); else also the
    old names that browsers take without one."""
    page = _Markdown()
    page.feed(_closed_only(html) if closed else html)
    page.close()
    text = "".join(page.out)
    title = " ".join("".join(page.title).split())
    if not page.headings and title:
        text = f"## {title}\n\n{text}"
    lines = [line.rstrip() if not line.endswith("  \n") else line for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def markdown(html: Column, closed: bool = False) -> Column:
    """Markdown of an HTML column by ``html_to_markdown``; null counts as empty."""

    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.fillna("").map(lambda page: html_to_markdown(page, closed))

    return work(html)
