"""Main text of pages."""

import html
import random
import re
import time
from pathlib import Path

import pandas as pd
import pytest

from tarn.llm.html import NO, NO_TEXT, SURE, SUSPECTED, Page, _beside, extract_pages, main_text, runs_of

NAV = '<nav><a href="/">Home</a> <a href="/b">About us</a></nav>'
FOOT = "<footer>&copy; 2024 A very long footer text that goes on and on and on</footer>"


def page(inner, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>if (a < b) x('</p>')</script></head><body>{NAV}{before}{inner}{after}{FOOT}</body></html>"


@pytest.mark.parametrize("source, text", [
    (page("<article><h1>Head</h1><p>One <b>bo</b>ld&nbsp;&amp; more.<p>Two.</article>"), "Head One bold & more. Two."),
    (page("<article><p>One.</p><div class='ad'>Buy</div><p>Two.</p><aside>Related</aside><form><label>Name</label><input></form><p>Three.</p></article>"), "One. Two. Three."),
    (page("<main><h1>Head</h1><p>Text.</p></main>", before="<div class='cookie-notice'>We use cookies and more cookies</div><header><h2>Site</h2></header>"), "Head Text."),
    (page("<div id='content'><h1>Head</h1><p>A paragraph of some length.</p><p>x</p><p>Another paragraph, too.</p></div>", after="<div class='sidebar'><p>" + "side " * 99 + "</p></div>"), "Head A paragraph of some length. x Another paragraph, too."),
    (page("<article><p>Body text.</p></article>", after="<section id='comments'><article class='comment'><p>" + "I like it. " * 50 + "</p></article></section>"), "Body text."),
    (page("<article><p>Body.</p><div class='comments'><p>Reader says " + "no " * 50 + "</p></div></article>"), "Body."),
    (page("<article><header><h1>Title in it</h1></header><p>Body.</p><footer>Tags</footer></article>"), "Title in it Body."),
    (page("<article><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>x\n  y</pre></article>"), "a b 1 2 x y"),
    (page("<article><p>a<br>b<!-- no --> c&lt;d&gt; &#233;&eacute;</p></article>"), "a b c<d> éé"),
    (page("<ul><li><a href='1'>One long link text here</a></li><li><a href='2'>Another long link text</a></li><li><a>and a third one</a></li></ul><p>Short text.</p>"), "Short text."),
    (page(""), ""), ("", ""), (None, ""), ("plain &amp; simple\n text", "plain & simple text"), ("<p>open <b>never closed", "open never closed"),
    ("<article><p title='a>b'>quoted</p><p title=\"unclosed>rest</p></article>", "quoted rest"),
    ("<article>a < b and c > d</article>", "a < b and c > d"), ("<script>never closed <p>x", ""),
    ("<article><p>  white \t\n space　here </p></article>", "white space here"),
])
def test_pages(source, text):
    assert main_text(source) == text


@pytest.mark.parametrize("source, text", [
    ("<div><p>part one</p><aside>Related</aside><p>part two</p></div>", "part one part two"),
    (page("<div><section><header>h</header><p>part one</p></section><section><header>h</header><p>part two</p></section></div>"), "part one part two"),
    (page("<div><article><p>part one</p></article><article><p>part two</p></article></div>"), "part one part two"),
    (page("<div><p>part one</p><nav>Pages</nav><p>part two</p></div>", before="<div><p>Site</p></div><nav>Menu</nav>"), "part one part two"),
])
def test_parts_of_one_container_stay_together(source, text):
    assert main_text(source) == text


@pytest.mark.skipif(not Path("/root/testdata").exists(), reason="needs the generated tables")
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_generated_pages_equal_their_articles(scale):
    pages = pd.read_parquet(f"/root/testdata/{scale}/pages.parquet")
    assert len(pages)
    for source in pages.html:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        assert main_text(source) == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())


LONG = "A sentence with quite some words in it, as texts have them. "


@pytest.mark.parametrize("source, text", [
    # no article, no main, no class that says anything
    ("<body><div class='x1'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News of today</a></li></ul></div><div class='x2'><h1>Head</h1><p>" + LONG + "</p><p>Short.</p><p>" + LONG + "</p></div><div class='x3'>Copyright 2024 Somebody</div></body>", f"Head {LONG}Short. {LONG}"),
    # columns in a wrapper
    ("<div><div><p><a>One</a></p><p><a>Two</a></p></div><div><p>" + LONG * 3 + "</p><p>" + LONG + "</p></div><div><p>Weather: fine</p><p>Votes: 17</p></div></div>", f"{LONG * 3}{LONG}"),
    # each paragraph in a box of its own, a picture between
    ("<div><div><div><p>" + LONG + "</p></div></div><div><img src=a></div><div><div>Why?</div></div><div><div><p>" + LONG + "</p></div></div></div><div><div>All rights reserved</div></div>", f"{LONG}Why? {LONG}"),
    # the head line in a box before the text
    ("<div><div><h1>Head</h1></div><div><p>" + LONG * 2 + "</p><p>" + LONG + "</p></div><div>Tags</div></div>", f"Head {LONG * 2}{LONG}"),
    # text right in the body
    ("<body><div><a>Menu</a></div><p>" + LONG + "</p><div>note</div><p>" + LONG + "</p><div>(c) 2024</div></body>", f"{LONG}note {LONG}"),
    # density decides against a small article
    ("<article><p>Teaser.</p></article><div><p>" + LONG * 2 + "</p><p>" + LONG * 2 + "</p></div>", f"{LONG * 2}{LONG * 2}"),
])
def test_pages_without_a_tag_that_tells(source, text):
    assert main_text(source) == text.strip()


ODD = [
    "<p>word ", "<", "<a href=\"", "<div class='ad'>", "&amp", "<!--", "<article>", "<a \"> \"", "<div>", "<div>a", "<article><div class='ad'>x</div>", "<div class='ad'><article>", "<script>", "</div>x", "<!x",
    "<p title='", "<div><p>text</p></div>", "<title>", "<div><div>x</div>", "<form>", "<a>", "<h1>x",
]


@pytest.mark.parametrize("part", ODD)
def test_steps_are_linear_in_the_page(part):
    """Tokens looked at, lines and runs, not seconds: four times the page is four times each."""
    def steps(times):
        page = Page(part * times + "x")
        return page.steps + len(page.lines) + len(runs_of(page.lines))

    assert steps(4_000) <= 4 * steps(1_000) + 50


NAMED = ["content with-sidebar", "no-sidebar", "post commentable", "ad-free", "hidden-gems", "related-reading-essay", "page-banner-article"]
TEXT = "The text of the page, some sentences long. " * 6


@pytest.mark.parametrize("beside", ["", "<p>short</p>", "<div class='footer'>All rights reserved, 2024</div>"])
@pytest.mark.parametrize("around", [*(f"<div class='{name}'>|</div>" for name in NAMED), "<form action='/'>|</form>", "<article class='promo'>|</article>", "<form><div class='no-sidebar'>|</div></form>"])
def test_names_alone_never_take_the_text(around, beside):
    begin, end = around.split("|")
    inner = f"<p>{TEXT}</p><p>{TEXT}</p>"
    assert main_text(page(begin + inner + end, after=beside)) == f"{TEXT}{TEXT}".strip()
    assert main_text(f"{begin}{inner}{end}") == f"{TEXT}{TEXT}".strip()


def test_suspected_parts_go_where_other_text_weighs_more():
    notes = "<div class='comments'><p>" + "Well said. " * 9 + "</p></div><div class='promo'><p>" + "Buy now. " * 9 + "</p></div>"
    assert main_text(page(f"<div><p>{TEXT}</p></div>{notes}")) == TEXT.strip()
    assert main_text(page(f"<div class='no-sidebar'><p>{TEXT}</p></div>{notes}")) == TEXT.strip()
    assert main_text(page(f"<article><p>{TEXT}</p>{notes}</article>")) == TEXT.strip()


def brute_judged(html):
    """The dropped elements by the definition: for each suspected one, in order, all other text counted anew."""
    view = Page(html)
    tokens, ends = view.tokens, view.ends
    size = [len("".join(name.split())) if kind == "text" else 0 for kind, name, _ in tokens]
    linked = False
    for k, (kind, name, _) in enumerate(tokens):
        linked = kind == "open" if name == "a" and kind != "text" else linked
        size[k] *= not linked
    in_article = [any(h < k < ends[h] or h < k and ends[h] < 0 for h in view.holders) for k in range(len(tokens))]
    kinds = {}
    for k, (kind, name, more) in enumerate(tokens):
        if kind != "open" or ends[k] <= k or k in view.is_holder or name in ("a", "html", "body"):
            continue
        encloses = any(k < h < ends[k] for h in view.holders)
        kinds[k] = SURE if name in NO_TEXT else NO if encloses else _beside(name, more, in_article[k])
        if name == "article":
            kinds[k] = SUSPECTED
    sure = [k for k, v in kinds.items() if v == SURE]
    sure = [k for k in sure if not any(s < k < ends[s] for s in sure)]
    for k in sure:
        size[k : ends[k]] = [0] * (ends[k] - k)
    suspects = [k for k, v in kinds.items() if v == SUSPECTED and not any(s < k < ends[s] for s in sure)]
    dropped, stays = set(sure), []
    for k in suspects:
        if any(d < k < ends[d] for d in dropped):
            continue
        around = [s for s in suspects if s < k < ends[s]]
        assert all(s in stays for s in around)
        level = [s for s in suspects if [x for x in suspects if x < s < ends[x]] == around]
        hidden = [s for s in suspects if s not in around and (s in level or not any(s < x < ends[s] for x in [k]) and not (around and around[-1] < s < ends[around[-1]]))]
        free = [i for i in range(len(tokens)) if not any(s <= i < ends[s] for s in hidden)]
        clean, article = sum(size[i] for i in free), sum(size[i] for i in free if in_article[i])
        own = sum(size[k : ends[k]])
        others = sum(sum(size[s : ends[s]]) for s in level if s != k)
        if own < clean * (100 if article else 10) + others or not own:
            dropped.add(k)
        else:
            stays.append(k)
    return view.dropped, dropped


@pytest.mark.parametrize("seed", range(300))
def test_judgements_against_brute_force(seed):
    rng = random.Random(seed)

    def made(depth):
        if depth == 0 or rng.random() < 0.25:
            return f"<p>{'word ' * rng.choice([1, 3, 30, 200])}</p>" + ("<a href=x>a link</a>" if rng.random() < 0.2 else "")
        name, attributes = rng.choice([("div", ""), ("div", " class='ad'"), ("div", " class='no-sidebar'"), ("form", ""), ("section", " id='comments'"), ("nav", ""), ("article", ""), ("article", " class='promo'"), ("span", " class='share'"), ("div", " hidden")])
        return f"<{name}{attributes}>" + "".join(made(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{name}>"

    fast, plain = brute_judged("".join(made(3) for _ in range(rng.randint(1, 4))))
    assert fast == plain


def test_long_and_odd_pages_end_soon():
    began = time.monotonic()
    for source in ("<p>word " * 50_000, "<" * 100_000, "<a href=\"" * 20_000, "<div class='ad'>" * 20_000 + "x", "&amp" * 100_000, "<!--" * 50_000, "<article>" * 5_000 + "x"):
        main_text(source)
    assert time.monotonic() - began < 20


def test_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)], "page_id long, text string, html string")
    got = extract_pages(rows, ["page_id"]).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == [("1", "a"), ("1", "a"), ("None", "")]
    assert extract_pages(rows.limit(0), ["page_id"]).count() == 0
