from __future__ import annotations

from logweir.llm.urls import blocked_bloom, judge, might_hold, _block
from pyspark.sql import functions as F

URLS = [
    (1, "HTTPS://WWW.Example.ORG/en/1?q"), (2, "http://example.org/es/x"), (3, "http://notexample.org/es/x"), (4, "https://a.com/fr/b#c"),
    (5, "https://a.com/de"), (6, "https://a.com/de/"), (7, "nothing"), (8, None), (9, ""), (10, "http://spam.net//a/b/?x=1"), (11, "http://spam.net/a/b"),
    (12, "http://spam.net:80/a/b#y"), (17, "http://spam.net:443/a/b"), (13, "ftp://h"), (14, "http://x.org?a/b"), (15, "a://b://c/d"), (10, "http://spam.net//a/b/?x=1"), (16, "http://" + "h" * 3000 + "/p"),
]
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(a, b, "x", "y", "mine", 5) for a, b in URLS], "page_id int, url string, host string, extra string, block string, w0 int")
    listed = spark.createDataFrame([("http://SPAM.net/a/b/",), ("http://spam.net/a/b",), (None,), ("no address",)], "url string")
    for bits in (None, 0, 3):
        got = {r["page_id"]: r for r in judge(pages, listed, RULES, bits=bits).collect()}
        rules = {k: r["rule"] for k, r in got.items() if r["rule"]}
        assert rules == {1: "example.org/en/1", 2: "example.org/es/", 3: "org/", 4: "com/fr/", 6: "com/de/"}
        assert {k for k, r in got.items() if r["verdict"] == "block"} == {1, 2, 6, 10, 11, 12}
        assert {k for k, r in got.items() if r["listed"]} == {10, 11, 12}
        assert (got[1]["host"], got[1]["path"]) == ("www.example.org", "/en/1")
        assert [(got[k]["host"], got[k]["path"]) for k in (7, 8, 9, 14)] == [("", ""), ("", ""), ("", ""), ("x.org", "")]
        assert (got[15]["host"], got[15]["path"]) == ("b:", "//c/d")
        assert (got[10]["extra"], got[10]["block"], got[10]["w0"]) == ("y", "mine", 5)
    assert judge(pages, listed, RULES).count() == len(URLS)


def test_no_list_and_no_pages(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id int, url string")
    assert [r["verdict"] for r in judge(pages, none).collect()] == ["allow"]
    assert judge(pages.where("page_id > 1"), pages).count() == 0


def test_filter_has_no_misses(spark):
    listed = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("u"))
    bits = 7
    bloom = blocked_bloom(listed, "u", bits)
    h = F.xxhash64("u")
    asked = spark.range(4000).select(F.concat(F.lit("u"), "id").alias("u"), "id").withColumn("__block", _block(h, bits))
    hits = asked.join(bloom, "__block", "left").where(might_hold(h)).select("id").collect()
    ids = {r["id"] for r in hits}
    assert ids >= set(range(2000))
    assert len(ids) < 2100
