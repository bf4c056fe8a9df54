"""Ranked search against the score of every document."""

import math
import random
import re
from collections import Counter

import pytest

from faultline.llm import search
from faultline.llm.queries import QUERIES


def _terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def _brute(docs, queries, k=10):
    live = [(key, Counter(_terms(t))) for key, t in docs if _terms(t)]
    n_docs, words = len(live), sum(sum(c.values()) for _, c in live)
    df = Counter(t for _, c in live for t in c)
    asked = {}
    for item, t in queries:
        asked.setdefault(item, set()).update(_terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for key, c in live:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if c[t])
            if score > 0:
                scored.append((-score, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(8)
    signs = [f"w{i}" for i in range(60)] + ["Éa", "éa", "9", "x-y", "a'b"]
    weights = [1 / (i + 1) for i in range(len(signs))]
    some = lambda n: " ".join(draw.choices(signs, weights, k=n))
    docs = [(i, some(draw.randrange(1, 60))) for i in range(400)]
    docs += [(3, docs[3][1]), (900, None), (901, ""), (902, "..."), (None, some(30)), (903, some(40_000))]
    docs += [(1_000 + i, "w50 w51 W52") for i in range(40)]
    queries = [(i, some(draw.randrange(1, 30))) for i in range(30)]
    queries += [(3, some(5)), (3, queries[3][1]), (50, None), (51, ""), (52, "none of these"), (53, "w52 w51"), (None, "w1 w40")]
    return (
        spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id bigint, text string, rank int, item string").repartition(5),
        spark.createDataFrame([(*q, 7) for q in queries], "item_id bigint, text string, score int"), docs, queries)


def test_all_scores(tables):
    docs, queries, rows, asked = tables
    got = search.ranked(docs, queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert _rows(got) == _brute(rows, asked)


def test_small_blocks_shards_and_slices(tables, monkeypatch):
    docs, queries, rows, asked = tables
    for name, value in (("SHARD_POSTINGS", 600), ("BLOCK_DOCS", 16), ("QUERY_CHARS", 900)):
        monkeypatch.setattr(search, name, value)
    assert _rows(search.ranked(docs, queries, k=3)) == _brute(rows, asked, 3)


@pytest.mark.parametrize("share", [0.0, 0.3, 1e9])
def test_any_split_of_short_and_long_lists(share):
    import numpy as np

    draw = np.random.default_rng(4)
    lists = [np.unique(draw.integers(0, 3_000, size)) for size in (3, 40, 40, 700, 2_500, 9_000)]
    pairs = sorted((d, t) for t, docs in enumerate(lists) for d in docs.tolist())
    sizes = np.bincount([d for d, _ in pairs], minlength=3_000)
    ids, tfs = np.array([t for _, t in pairs]), draw.integers(1, 9, len(pairs))
    corpus = search.Corpus(3_000, 90_000, np.array([8000, 5000, 5000, 1500, 200, 1]))
    shard = search.Shard(draw.integers(9, 60, 3_000), sizes, ids, tfs, corpus)
    total = np.zeros(3_000, np.int64)
    for t in range(6):
        docs, impacts = shard.list(t)
        total[docs] += impacts
    docs, scores = shard.best(list(range(6)), 10, share)
    want = sorted(range(3_000), key=lambda d: (-total[d], d))[:10]
    assert docs.tolist() == want and scores.tolist() == total[want].tolist()


def test_empty_tables(tables):
    docs, queries, _, _ = tables
    assert search.ranked(docs.where("false"), queries).count() == 0
    assert search.ranked(docs, queries.where("false")).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert _rows(QUERIES["op12_ranked_search"](spark, sf)) == _brute(docs, items)
