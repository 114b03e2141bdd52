"""Spotting of aliases against one regular expression of them all, and in large dictionaries."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import rewrite

LETTERS = "aAbB1 -.请求é"


def by_expression(aliases, text):
    """Leftmost matches of an alternation, the longest expression first."""
    each = [(("(?<![A-Za-z0-9])" if re.match("[A-Za-z0-9]", a[0]) else "") + re.escape(a) + ("(?![A-Za-z0-9])" if re.match("[A-Za-z0-9]", a[-1]) else ""), a) for a in aliases]
    finder = re.compile("|".join(f"(?P<g{i}>{e})" for i, (e, _) in sorted(enumerate(each), key=lambda x: (not re.match("[A-Za-z0-9]", x[1][1][-1]), -len(x[1][1])))), re.IGNORECASE)
    return [(*m.span(), each[int(m.lastgroup[1:])][1]) for m in finder.finditer(text)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(LETTERS, min_size=1, max_size=4).filter(str.strip), min_size=1, max_size=6, unique_by=lambda a: a.strip().casefold()), st.text(LETTERS, max_size=25))
def test_spots_are_those_of_one_expression(aliases, text):
    known = rewrite.check_aliases({a: "name" for a in aliases})
    assert [x[:3] for x in rewrite.Rewriter(known).found(text)] == by_expression([*known], text)


def test_a_hundred_thousand_aliases(spark):
    many = {f"k{i}x": f"Key {i}" for i in range(100_000)} | {"数据库": "Database", "数据": "Data"}
    rows = spark.createDataFrame([("a K7X, k99999x and k5xy",), ("数据库的数据",)], "query string")
    got = {r["query"]: (r["effective_query"], r["applied_rules"]) for r in rewrite.rewrite_queries(rows, many).collect()}
    assert got["a K7X, k99999x and k5xy"] == ("a Key 7 (K7X), Key 99999 (k99999x) and k5xy", ["alias:k7x", "alias:k99999x"])
    assert got["数据库的数据"] == ("Database (数据库)的Data (数据)", ["alias:数据库", "alias:数据"])


def test_folding_keeps_places():
    assert rewrite._folded("STRAßE İx") == "straße İx" and len(rewrite._folded("ŉa")) == 2
