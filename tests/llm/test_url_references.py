"""Targets of redirects and canonical links: relative references, tokens, several tags, comments."""

import pytest
from pyspark.sql import functions as F

from faultline.llm import urls
from faultline.llm.queries import URL_RULES


@pytest.mark.parametrize("target, want", [
    ("page.html", "http://h.de/a/b/page.html"), ("../x", "http://h.de/a/x"), ("../../../x?y=../z", "http://h.de/x?y=../z"),
    ("./", "http://h.de/a/b/"), ("..", "http://h.de/a/"), ("?id=1", "http://h.de/a/b/c?id=1"), ("#top", "http://h.de/a/b/c?q=/r#top"),
    ("/login?next=http://x", "http://h.de/login?next=http://x"), ("p?next=http://x", "http://h.de/a/b/p?next=http://x"),
    ("//bad.net/z", "http://bad.net/z"), ("HTTPS://bad.net/z", "HTTPS://bad.net/z"), ("mailto:a@b", None), (None, None),
    ("/a/./b/../c", "http://h.de/a/c"), ("x&amp;y", "http://h.de/a/b/x&y"),
])
def test_references(spark, target, want):
    row = spark.createDataFrame([(target, "http://h.de/a/b/c?q=/r")], "t string, b string")
    assert row.select(urls.resolved(F.col("t"), F.col("b"))).first()[0] == want


def test_a_base_without_a_path_and_no_base(spark):
    rows = spark.createDataFrame([("x", "http://h.de"), ("?q", "http://h.de"), ("x", "no url"), ("x", None)], "t string, b string")
    got = [r[0] for r in rows.select(urls.resolved(F.col("t"), F.col("b"))).collect()]
    assert got == ["http://h.de/x", "http://h.de/?q", None, None]


@pytest.mark.parametrize("html, want", [
    ("<link rel='alternate Canonical' href='n.html'>", ["http://h.de/d/n.html"]),
    ("<link rel=canonical href=/1><link rel=canonical href=/2>", ["http://h.de/1", "http://h.de/2"]),
    ("<!-- <link rel=canonical href=/1> --><link rel=canonical href=/2>", ["http://h.de/2"]),
    ("<script>'<link rel=canonical href=/1>'</script><link rel=canonical href=/2>", ["http://h.de/2"]),
    ("<link title='rel=canonical href=/1' rel=next href=/3>", []), ("<link title='a>b' rel=canonical href=/2 />", ["http://h.de/2"]),
    ("<link rel=noncanonical href=/1><link rel='x-canonical' href=/2>", []),
    ("<meta content='0; url=../r' http-equiv=Refresh>", ["http://h.de/r"]), ("<meta http-equiv=refresh content='5'>", []),
    ("""<meta http-equiv=refresh content="0;URL='q?url=/y'">""", ["http://h.de/d/q?url=/y"]),
    ("<base href='http://o.org/x/'><link rel=canonical href=n>", ["http://o.org/x/n"]), ("<link rel=canonical>", []),
])
def test_edges_of_a_page(spark, html, want):
    pages = spark.createDataFrame([("http://h.de/d/p?q", html), (None, html)], "url string, html string")
    assert sorted(r["target"] for r in urls.page_edges(pages).collect()) == want


def test_blocks_reach_aliases_by_relative_links(spark):
    pages = spark.createDataFrame([
        (1, "http://a.de/x/1", "<link rel='shortlink canonical' href='2'>"),
        (2, "http://a.de/x/2", "<meta http-equiv=refresh content='0; url=?go=http://ok.de'>"),
        (3, "http://a.de/x/2?go=http://ok.de", "<link rel=canonical href=http://ok.de/><link rel=canonical href=http://bad.net/>"),
    ], "page_id bigint, url string, html string")
    out = urls.judged(pages.select("page_id", "url"), URL_RULES, urls.page_edges(pages))
    assert [r["verdict"] for r in out.collect()] == ["block"] * 3


@pytest.mark.parametrize("value, want", [
    ("a&#47;b", "a/b"), ("a&#x2f;b&#X2F", "a/b/"), ("&#233;&#xe9;", "éé"), ("&#;&#xg;&#0;&#55296;", "&#;&#xg;&#0;&#55296;"),
    ("x&amp;y&quot;&sol;", "x&y\"/"), ("&amp;#47;", "&#47;"), ("", ""), (None, None), ("&#8364", "€"),
])
def test_character_references(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(urls.decoded(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("one, other", [
    ("http://a.de", "http://a.de/"), ("HTTP://A.de:80/x", "http://a.de/x"), ("https://a.de:443", "https://a.de/#top"),
    ("http://a.de?q", "http://a.de/?q"), ("http://a.de/%e4%2F", "http://a.de/%E4%2f"), ("http://a.de:/x", "http://a.de/x"),
])
def test_urls_of_one_resource(spark, one, other):
    row = spark.createDataFrame([(one, other)], "a string, b string")
    a, b = row.select(urls.resource(F.col("a")), urls.resource(F.col("b"))).first()
    assert a == b


@pytest.mark.parametrize("one, other", [
    ("http://a.de:443/", "http://a.de/"), ("http://a.de/x", "http://a.de/X"), ("http://a.de/x", "https://a.de/x"), ("http://a.de/%zz", "http://a.de/%ZZ")])
def test_urls_of_two_resources(spark, one, other):
    row = spark.createDataFrame([(one, other)], "a string, b string")
    a, b = row.select(urls.resource(F.col("a")), urls.resource(F.col("b"))).first()
    assert a != b


def test_an_alias_without_a_path_is_blocked(spark):
    pages = spark.createDataFrame([
        (1, "http://a.de", "<link rel=canonical href='http:&#47;&#47;bad.net/'>"), (2, "http://b.de/", "<link rel=canonical href='http://a.de/'>"),
    ], "page_id bigint, url string, html string")
    out = urls.judged(pages.select("page_id", "url"), URL_RULES, urls.page_edges(pages))
    assert [r["verdict"] for r in out.collect()] == ["block"] * 2
