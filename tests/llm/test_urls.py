"""Connected components and url decisions."""

import random

import pytest

from faultline.llm import urls
from faultline.llm.components import components
from faultline.llm.queries import QUERIES, URL_RULES


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("name", ["random", "chain", "star", "odd"])
def test_components(spark, name):
    draw = random.Random(9)
    edges = {
        "random": [(draw.randrange(300), draw.randrange(300)) for _ in range(220)],
        "chain": [(k, k + 1) for k in range(150)],
        "star": [(1000, k) for k in range(400)] + [(k, 1000) for k in range(50)],
        "odd": [(None, 1), (2, None), (3, 3), (4, 5), (5, 4), (4, 5)],
    }[name]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r["vertex"]: r["component"] for r in out} == _brute(edges) and len(out) == len(_brute(edges))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://", "", ""), ("HTTP://A.Net", "a.net", ""),
    ("http://A.ÉX.net/P?q#f", "a.Éx.net", "/P"), ("x://h?q=/a", "h", ""), ("x://h#/a", "h", ""), ("a://b://c/d", "b:", "//c/d"),
    ("http://h/a\nb?c", "h", "/a\nb"), ("http://u:p@h:80/", "u:p@h:80", "/"),
])
def test_host_and_path(spark, url, host, path):
    from pyspark.sql import functions as F

    h, p = urls.host_path(F.col("u"))
    assert tuple(spark.createDataFrame([(url,)], "u string").select(h, p).first()) == (host, path)


def test_longest_rule_wins(spark):
    rules = (*URL_RULES, ("Tie.com", "/a", "block"), ("tie.com", "/a", "allow"))
    want = {
        "http://x.net/": ("net/", "block"), "http://x.net": (None, "allow"), "http://anet/": (None, "allow"),
        "http://m.example.net/en/1": ("example.net/en/", "allow"), "http://badexample.net/en/1": ("net/", "block"),
        "http://NET/q": ("net/", "block"), "http://a.org/fr/": ("org/fr/", "allow"), "http://a.org/en/": (None, "allow"),
        "http://example.com/de/x": ("example.com/de/", "block"), "http://tie.com/ab": ("tie.com/a", "allow"),
    }
    pages = spark.createDataFrame([(u, "own", 1) for u in want], "url string, verdict string, n int")
    edges = spark.createDataFrame([], "source string, target string")
    out = urls.judged(pages, rules, edges).collect()
    assert {r["url"]: (r["rule"], r["verdict"]) for r in out} == want and out[0]["n"] == 1


def test_decisions_reach_aliases(spark):
    link = lambda u: f'<html><head><LINK data-x=1 rel="canonical" href="{u}"></head></html>'
    pages = [
        (1, "http://a.example.de/1", link("http://b.example.de/1")),
        (2, "http://b.example.de/1", "<meta http-equiv='refresh' content='0; URL=http://bad.net/x#f'>"),
        (3, "http://c.example.de/1#top", link("http://a.example.de/1")),
        (4, "http://d.example.de/1", link("http://e.example.de/1")),
        (5, "http://e.example.de/1", link("http://bad.net/y") + '<meta http-equiv="refresh" content="3;url=http://ok.org/fr/">'),
        (6, "http://f.example.de/1", "<a href='http://bad.net/x'>canonical refresh</a>"),
        (7, "http://g.example.de/1?a=1&b=2", "<link href=/2 rel=canonical>"),
        (8, "http://g.example.de/2", link("//bad.net/z")),
        (9, None, link("http://bad.net/z")), (10, "http://h.example.de/", None), (1, "http://a.example.de/1", None),
        (11, "http://i.org/fr/x", link("http://bad.net/x")),
    ]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    out = urls.judged(table.select("page_id", "url"), URL_RULES, urls.page_edges(table))
    got = sorted((r["page_id"], r["verdict"]) for r in out.collect())
    # 1, 2, 3 and 11 share a component with an explicit allow; so do 4 and 5
    assert got == sorted([
        (1, "allow"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "block"),
        (8, "block"), (9, "allow"), (10, "allow"), (11, "allow")])
    out = urls.judged(table.where("page_id < 11").select("page_id", "url"), URL_RULES, urls.page_edges(table.where("page_id < 11")))
    assert {r["page_id"] for r in out.where("verdict = 'block'").collect()} == {1, 2, 3, 7, 8}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.judged(none.select("page_id", "url"), URL_RULES, urls.page_edges(none)).count() == 0


def test_query_has_no_python(spark, sf):
    plan = QUERIES["op6_url_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
