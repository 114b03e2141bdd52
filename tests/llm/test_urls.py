"""URL filter."""

import pytest
from pyspark.sql import functions as F

from tarn.llm.urls import judge_urls


def judged(spark, *urls, **more):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").coalesce(1)
    return [r["url_verdict"] for r in judge_urls(rows, **more).orderBy("page_id").collect()]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.COM/fr/x?y#z", "a.example.com", "/fr/x", "com/fr/", "allow"),
    ("https://x.com/de/casino", "x.com", "/de/casino", "com/de/", "block"),
    ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://sub.example.org/en/12", "sub.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://org", "org", "", None, "allow"),
    ("http://org/", "org", "/", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://a.com?b=/fr/", "a.com", "", None, "allow"),
    ("http://a.com#b", "a.com", "", None, "allow"),
    ("no scheme/fr/", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"), ("a://b://c/fr/", "b:", "//c/fr/", None, "allow"),
    ("http://a.net/casino", "a.net", "/casino", None, "block"),
    ("http://a.net/casinova", "a.net", "/casinova", None, "allow"),
    ("http://a.net/free", "a.net", "/free", None, "allow"),
    ("http://a.net/free-free", "a.net", "/free-free", None, "allow"),
    ("http://a.net/FREE-bet", "a.net", "/FREE-bet", None, "block"),
    ("http://a.net/freebet", "a.net", "/freebet", None, "allow"),
    ("http://ä.net/é-xxx-é", "ä.net", "/é-xxx-é", None, "block"),
    ("http://a.net/\nx", "a.net", "/\nx", None, "allow"),
])
def test_judgement(spark, url, host, path, rule, verdict):
    got = judged(spark, url)[0]
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, verdict)


def test_counts_are_of_different_terms(spark):
    got = judged(spark, "http://a.net/free/free/bet?casino=porn", "x" * 100_000 + "-bet")
    assert (got[0]["strict_hits"], got[0]["soft_hits"]) == (2, 2) and got[1]["soft_hits"] == 1


def test_overlapping_terms_and_no_terms(spark):
    got = judged(spark, "http://a.net/slots", strict=["slots-free"], soft=["slot", "slots"])[0]
    assert (got["strict_hits"], got["soft_hits"]) == (0, 1)
    assert judged(spark, "http://a.net/casino", strict=[], soft=[])[0]["verdict"] == "allow"


def test_columns_stay_and_empty(spark):
    rows = spark.createDataFrame([("http://a.net", "x", 1)], "url string, host string, url_verdict int")
    row = judge_urls(rows).first()
    assert row["host"] == "x" and row["url_verdict"]["host"] == "a.net"
    assert judge_urls(rows.limit(0)).select(F.col("url_verdict.verdict")).count() == 0
