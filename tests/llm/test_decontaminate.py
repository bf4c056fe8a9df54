"""Benchmark windows against a brute-force search."""

import hashlib
import random
import re

import numpy as np
import pytest

from faultline.llm import decontaminate
from faultline.llm.queries import QUERIES


def _brute(text, items, width=10):
    def words(t):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, met = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(width, len(v))
        windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1 if v else 0):
            if tuple(w[k:k + n]) in windows:
                hit.update(range(k, k + n))
                met.add(str(item))
    return len(w), len(hit), sorted(met)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(3)
    signs = ["Éa", "éa", "b2", "C", "d-e", "f"]
    some = lambda n: " ".join(draw.choice(signs) for _ in range(n))
    items = [(1, some(14)), (2, some(25)), (10, "Zulu, yankee"), (11, ""), (12, None), (2, "x y z"), (13, some(10)), (14, "éa")]
    docs = [(k, some(200)) for k in range(8)] + [
        (20, None), (21, ""), (22, "..."), (23, "a ZULU yankee zulu"), (24, "intro " + items[1][1].upper() + "! outro"),
        (24, "intro " + items[1][1] + "! outro"), (25, items[0][1]), (26, ("filler " * 30_000) + items[0][1])]
    schema = "doc_id bigint, text string, items string, item_id bigint"
    return (
        spark.createDataFrame([(*d, "own", 1) for d in docs], schema),
        spark.createDataFrame(items, "item_id bigint, text string"), items)


def _check(found, items):
    for r in found.collect():
        n, hit, met = _brute(r["text"], items)
        assert (r["n_words"], sum(b - a + 1 for a, b in r["hits"]), r["items"]) == (n, hit, met), r["doc_id"]


def test_hits(tables):
    docs, benchmark, items = tables
    found = decontaminate.with_hits(docs, benchmark)
    assert found.count() == docs.count() and "item_id" in found.columns
    _check(found, items)


def test_a_benchmark_beyond_the_bound_is_scanned_in_slices(tables, monkeypatch):
    docs, benchmark, items = tables
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 40)
    _check(decontaminate.with_hits(docs, benchmark), items)


def test_equal_windows_are_compared_once(monkeypatch):
    """A passage that stands 2,000 times in an item and in a text, and in 500 more items."""
    rest = [(str(k), "lang und länger. " * 4 + f"own{k}") for k in range(500)]
    index = decontaminate.Index.of([("many", "lang und länger. " * 2000), *rest, ("other", "lang und kurz " * 4)], 10)
    compared, text = [], index.text
    monkeypatch.setattr(index, "text", lambda *at: compared.append(at) or text(*at))
    assert len(index.windows[10][0]) == 3 + 500 + 3 and len(compared) <= 6000 + 500 * 4 + 3 + 3 + 3
    compared.clear()
    total, hits, items = index.scan("Lang und länger. " * 2000)
    assert (total, hits, items) == (6000, [(0, 5999)], {"many", *(k for k, _ in rest)})
    assert len(compared) == 5991


def test_equal_hashes_of_other_words(monkeypatch):
    """With one hash for all windows the words alone tell them apart."""
    monkeypatch.setattr(decontaminate, "_mixed", lambda hashes, width: np.zeros(len(hashes) - width + 1, np.uint64))
    draw = random.Random(7)
    some = lambda n: " ".join(draw.choice("ab") for _ in range(n))
    items = [("1", some(9)), ("2", some(30)), ("3", ""), ("4", some(30)), ("1", "b a"), ("5", "c")]
    index = decontaminate.Index.of(items, 4)
    for text in (some(3), some(40), f"c {some(12)}", f"x {items[1][1]} x", "b", ""):
        total, hits, met = index.scan(text)
        assert (total, sum(b - a + 1 for a, b in hits), sorted(met)) == _brute(text, items, 4)


def test_removal(tables):
    docs, benchmark, items = tables
    clean = {r["doc_id"] for r in docs.collect() if not _brute(r["text"], items)[1]}
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns
    cut = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs, benchmark).collect()}
    assert cut[23] == "a  zulu" and cut[24] == "intro ! outro" and cut[20] is None


def test_empty_tables(tables):
    docs, benchmark, _ = tables
    assert decontaminate.with_hits(docs.where("false"), benchmark).count() == 0
    assert {r["n"] for r in decontaminate.with_hits(docs, benchmark.where("false")).selectExpr("size(hits) n").collect()} == {0}


def test_query(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_decontamination"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, met = _brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(met), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(met).encode()).hexdigest()
