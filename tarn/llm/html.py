"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. What HTML itself sets beside the text (nav,
footer, aside ..., hidden parts) leaves nothing. A form, and a part whose class, id or role says advert,
comments or the like, is only suspected: its text weighs a LISTED-th of what it has (an ARTICLE_LISTED-th
where an article or main part holds other text), and it goes if what is left of the page without it weighs
more. So a page in a form, or one whose text stands in a box of class ``no-sidebar``, keeps its text. A
line counts with its characters outside links, a list of links not at all, and each edge of a container
(div, article ... but not a paragraph, list or table) is as many empty lines as the sliding window has.
The window's sum surges from nothing where a run of text begins and dives to nothing where it ends; its
greatest sum is the run's density.

The heaviest run is the core of the main text. All runs in the core's container belong to it. Then the
container widens to the one around it, which adds what lies from the first to the last run of over half
the core's density, and a heading just before, until there is none. So a column of
short notes, a list of links or a line of copyright beside the text stays out whatever its class is
called. ``article`` and ``main`` are containers whose text stands and falls together; they settle what
is near a tie (theirs counts ARTICLE_WEIGHT times), and articles beside the core's are read with it.

Every step is linear in the page: a tag's quotes are trusted until one is never closed, and nothing is
looked for behind the last ``>``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of the sliding window.
WINDOW = 3
#: An article's or main part's text counts so many times where it is weighed against other runs.
ARTICLE_WEIGHT = 2
#: A line with a larger share of its characters in links is a link list and counts as empty.
LINK_SHARE = 0.6
#: A part that is suspected by its names weighs a share of one in so many of its text.
LISTED, ARTICLE_LISTED = 10, 100

#: Elements whose text is no text of the page.
NO_TEXT = frozenset("head title script style noscript template svg math iframe object canvas audio video map textarea select option datalist button input label fieldset legend meter progress".split())
#: Elements beside the text, and one that may be.
BESIDE = frozenset("nav aside footer dialog menu search".split())
MAY_BE_BESIDE = frozenset({"form"})
#: What ``_beside`` says of an element.
NO, SUSPECTED, SURE = range(3)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr output q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that name parts beside the text: whole words, and beginnings of words.
NAMES = frozenset(
    "ad ads adv banner masthead menu menubar nav toolbar pager pagination share sharing social related widget popup modal overlay consent gdpr notice notices alert toast promo login signup"
    " subscribe subscription search complementary contentinfo navigation dialog form disqus reply replies respond hidden".split()
)
BEGINNINGS = ("advert", "comment", "cookie", "sidebar", "footer", "navbar", "breadcrumb", "sponsor", "newsletter", "promo", "subnav", "topnav", "disclaimer", "recommend")
#: Only outside an article: there it can hold the title.
OUTSIDE = frozenset({"header"})

#: Blocks that are a part of a text, not its container.
PARTS = frozenset("html body p section h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure table tbody thead tfoot tr td th br hr".split())
HEADINGS = frozenset("h1 h2 h3".split())
HOLDERS = frozenset({"article", "main"})

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_COMMENT_END = re.compile(r"--!?>")
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+")


def _beside(name: str, attributes: str, in_article: bool) -> int:
    """Whether the element is a part beside the text: NO, SUSPECTED by its names, or SURE."""
    if name in BESIDE or name in OUTSIDE and not in_article:
        return SURE
    if not attributes:
        return SUSPECTED if name in MAY_BE_BESIDE else NO
    if _HIDDEN.search(attributes):
        return SURE
    if name in MAY_BE_BESIDE:
        return SUSPECTED
    for found in _NAMED.finditer(attributes):
        for part in _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found[1] or found[2] or found[3] or "").lower()):
            if part in NAMES or part.startswith(BEGINNINGS) or part in OUTSIDE and not in_article:
                return SUSPECTED
    return NO


def _tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, open or close. Comments and raw elements go."""
    out, at, n, quotes = [], 0, len(html), True
    last = html.rfind(">")
    begin = 0  # of the text at hand

    def text(until: int) -> None:
        if until > begin:
            out.append(("text", html[begin:until], ""))

    while True:
        at = html.find("<", at)
        if at < 0:
            break
        if html.startswith("<!--", at):
            text(at)
            short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, at)), "")
            end = None if short else _COMMENT_END.search(html, at + 4)
            begin = at = at + len(short) if short else end.end() if end else n
            continue
        if at > last:
            break
        found = _NAME.match(html, at + 1)
        if not found:
            if html[at + 1 : at + 2] in ("!", "?", "/"):
                text(at)
                begin = at = html.index(">", at) + 1
            else:
                at += 1
            continue
        whole = _QUOTED.match(html, found.end()) if quotes else None
        if not whole:
            quotes = False
        end = whole.end() if whole else html.index(">", at) + 1
        text(at)
        begin = at = end
        name = found[2].lower()
        if found[1]:
            out.append(("close", name, ""))
            continue
        out.append(("open", name, html[found.end() : end - 1]))
        if name in RAW:
            closing = _closing(name).search(html, at)
            begin = at = closing.start() if closing else n
            if not closing:
                out.append(("close", name, ""))
    text(n)
    return out


@lru_cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}[\s/>]", re.I)


def _ends(tokens: list[tuple[str, str, str]]) -> list[int]:
    """For each opening tag the token that closes it, or -1."""
    ends, opened = [-1] * len(tokens), defaultdict(list)
    for k, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name not in VOID:
            opened[name].append(k)
        elif kind == "close" and opened[name]:
            ends[opened[name].pop()] = k
    return ends


class Line(NamedTuple):
    text: str
    weight: int
    container: int  # opening token of the nearest container, -1 for the page
    holder: int  # opening token of the article or main part, or -1
    heading: bool


class Page:
    """Lines of a page and the containers around them; text without weight is an empty line."""

    def __init__(self, html: str):
        self.tokens = _tokens(html)
        self.ends = _ends(self.tokens)
        self.lines: list[Line] = []
        #: The container around each container.
        self.around: dict[int, int] = {}
        #: Tokens looked at by all passes: what the page's cost is counted by.
        self.steps = len(self.tokens)
        holders = [k for k, (kind, name, more) in enumerate(self.tokens) if kind == "open" and name in HOLDERS and not (name == "article" and _beside(name, more, True))]
        # main parts hold the text only where no article does
        if any(self.tokens[k][1] == "article" for k in holders):
            holders = [k for k in holders if self.tokens[k][1] == "article"]
        self.holders, self.is_holder = holders, set(holders)
        self.dropped = self._judged()
        self._read()

    def _encloses_article(self, k: int) -> bool:
        inner = bisect_left(self.holders, k)
        return inner < len(self.holders) and self.holders[inner] < self.ends[k]

    def _judged(self) -> set[int]:
        """Opening tokens of the elements that leave nothing: those that are beside the text, and of the
        suspected ones those that weigh less than the page without them. An element that encloses an article
        is neither."""
        tokens, ends = self.tokens, self.ends
        dropped: set[int] = set()
        suspects: dict[int, list[int]] = defaultdict(list)  # by the suspected element around them, -1: the page
        inside, held = [-1], []  # open suspects and articles
        weight, in_article = [0], [0]  # characters of text before each token, all and in articles
        k = linked = 0
        while k < len(tokens):
            self.steps += 1
            kind, name, more = tokens[k]
            while len(inside) > 1 and ends[inside[-1]] <= k:
                inside.pop()
            while held and 0 <= ends[held[-1]] <= k:
                held.pop()
            n, after = 0, k + 1
            if kind == "text":
                n = 0 if linked else len("".join(name.split()))
            elif name == "a":
                linked = int(kind == "open")
            elif kind == "open" and name not in ("html", "body"):
                if k in self.is_holder:
                    held.append(k)
                elif ends[k] > k:
                    is_article = name == "article"
                    beside = SURE if name in NO_TEXT else _beside(name, more, bool(held))
                    if beside != NO and name not in NO_TEXT and self._encloses_article(k):
                        beside = NO
                    if beside == SURE:
                        dropped.add(k)
                        after = ends[k]
                    elif beside != NO or is_article:
                        suspects[inside[-1]].append(k)
                        inside.append(k)
            for _ in range(after - k):
                weight.append(weight[-1] + n)
                in_article.append(in_article[-1] + (n if held else 0))
            k = after

        def of(sums: list[int], k: int) -> int:
            return sums[ends[k]] - sums[k]

        todo = [(-1, weight[-1], in_article[-1])] if suspects else []
        while todo:  # a suspected element that stays is as any other for those inside it
            outer, clean, clean_article = todo.pop()
            own = suspects[outer]
            all_of_them = sum(of(weight, k) for k in own)
            clean, clean_article = clean - all_of_them, clean_article - sum(of(in_article, k) for k in own)
            for k in own:
                self.steps += 1
                rest = clean * (ARTICLE_LISTED if clean_article else LISTED) + all_of_them - of(weight, k)
                if of(weight, k) < rest or not of(weight, k):
                    dropped.add(k)
                elif k in suspects:
                    todo.append((k, clean + of(weight, k), clean_article + of(in_article, k)))
        return dropped

    def _read(self) -> None:
        tokens, ends = self.tokens, self.ends
        edge = [Line("", 0, -1, -1, False)] * WINDOW
        words: list[str] = []
        opened: list[int] = []  # containers that are open
        held: list[int] = []  # articles that are open
        linked = in_link = k = 0
        heading = False

        def close_line() -> None:
            nonlocal linked, heading
            text = " ".join("".join(words).split())
            if text:
                weight = max(1, len(text) - linked) if held or linked <= LINK_SHARE * len(text) else 0
                self.lines.append(Line(text, weight, opened[-1] if opened else -1, held[0] if held else -1, heading))
            words.clear()
            linked, heading = 0, False

        def leave() -> None:
            """Containers that end at token k or before."""
            while opened and ends[opened[-1]] <= k:
                opened.pop()
                self.lines += edge
            while held and 0 <= ends[held[-1]] <= k:
                held.pop()

        while k < len(tokens):
            self.steps += 1
            kind, name, _ = tokens[k]
            if kind == "text":
                text = unescape(name)
                words.append(text)
                linked += len(text.strip()) * bool(in_link)
            elif name == "a":
                in_link = int(kind == "open")
            elif name in INLINE:
                pass
            elif name == "br":
                words.append(" ")
            else:
                close_line()
                leave()
                if k in self.dropped:
                    k = ends[k]
                    self.lines += edge
                    continue
                if kind == "open" and name not in PARTS and ends[k] > k:
                    self.around[k] = opened[-1] if opened else -1
                    opened.append(k)
                    self.lines += edge
                if kind == "open" and k in self.is_holder:
                    held.append(k)
                heading = kind == "open" and name in HEADINGS
            if kind == "open" and name in INLINE and k in self.dropped:
                k = ends[k]
            k += 1
        close_line()


class Run(NamedTuple):
    first: int
    last: int
    weight: int
    density: int


def runs_of(lines: Sequence[Line]) -> list[Run]:
    """From each surge to the dive after it, which comes when nothing is in the window's lines."""
    out: list[Run] = []
    first = last = -1
    weight = density = 0
    for i, line in enumerate(lines):
        if line.weight:
            if first < 0:
                first, weight, density = i, 0, 0
            last, weight = i, weight + line.weight
            density = max(density, sum(x.weight for x in lines[max(first, i - WINDOW + 1) : i + 1]))
        elif first >= 0 and i - last >= WINDOW:
            out.append(Run(first, last + 1, weight, density))
            first = -1
    return out + ([Run(first, last + 1, weight, density)] if first >= 0 else [])


def main_text(html: str | None) -> str:
    """The text of the core run's widened container, its lines joined by one space."""
    page = Page(html or "")
    lines, around = page.lines, page.around
    runs = runs_of(lines)
    if not runs:
        return ""
    by_holder: dict[int, int] = defaultdict(int)
    for line in lines:
        by_holder[line.holder] += line.weight

    def score(run: Run) -> tuple[int, int]:
        holder = lines[run.first].holder
        return (run.weight if holder < 0 else ARTICLE_WEIGHT * by_holder[holder], run.weight)

    core = max(runs, key=score)
    holder = lines[core.first].holder
    if holder >= 0:
        beside = {h for h in by_holder if h >= 0 and around.get(h, -1) == around.get(holder, -1)}
        return " ".join(line.text for line in lines if line.text and line.holder in beside)
    # of the core's lines, the container that holds all
    path = [lines[core.first].container]
    while path[-1] >= 0:
        path.append(around[path[-1]])
    level = {c: i for i, c in enumerate(path)}

    def depth(container: int) -> int:
        """Place in the path of the nearest container that is on it."""
        passed = []
        while container not in level:
            passed.append(container)
            container = around[container]
        level.update(dict.fromkeys(passed, level[container]))
        return level[container]

    def of(run: Run) -> int:
        return max(depth(line.container) for line in lines[run.first : run.last] if line.weight)

    at = [of(run) for run in runs]
    by_level: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(at):
        by_level[x].append(i)
    own = at[runs.index(core)]
    inside = [i for i, x in enumerate(at) if x <= own]
    # in its own container all runs, but on the page itself only what a wider container may add
    taken = set(inside) if path[own] >= 0 else {runs.index(core)}
    for wider in sorted(x for x in by_level if x > own or path[x] < 0):
        low, high = min(taken), max(taken)
        dense = [i for i in by_level[wider] if 2 * runs[i].density > core.density]
        low, high = min([low, *dense]), max([high, *dense])
        taken |= {i for i in range(low, high + 1) if at[i] <= wider}
        if low and at[low - 1] <= wider and any(line.heading for line in lines[runs[low - 1].first : runs[low - 1].last]):
            taken.add(low - 1)
        if not dense:
            break
    return " ".join(line.text for i in sorted(taken) for line in lines[runs[i].first : runs[i].last] if line.text)


def extract(html: Column) -> Column:
    """Main text of an HTML column; null and empty give empty."""

    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    return work(html.cast("string"))


def extract_pages(pages: DataFrame, keep: Sequence[str], html: str = "html", into: str = "text") -> DataFrame:
    """The columns of ``pages`` named in ``keep``, then the main text.

    Row by row, without a shuffle. A page with no text outside markup, a null and an empty one give
    the empty string; broken markup is read as far as tags can be told; a page without tags is text.
    Repeated rows each give their own. ``keep`` may not hold the new name.
    """
    return pages.select(*(F.col(f"`{c}`") for c in keep), extract(F.col(f"`{html}`")).alias(into))
