"""Weak supervision: held-out accuracy, the label model, odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import toxicity
from faultline.llm.queries import QUERIES

INSULTS = ["grobla", "snarfen", "zuvik", "plomt", "drekko", "moppel"]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(21)
    syllables = ["ba", "ti", "ro", "ne", "lu", "ka", "mi", "so"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    docs, labels = [], []
    for k in range(1500):
        words = [word() for _ in range(draw.randrange(5, 200))]
        bad = draw.random() < 0.12
        if bad:
            for _ in range(draw.randrange(1, 5)):
                stem = draw.choice(INSULTS)
                words.insert(draw.randrange(len(words)), stem + (draw.choice(syllables) if draw.random() < 0.4 else ""))
        docs.append((k, " ".join(words)))
        if draw.random() < 0.7:
            labels.append((k, 1, int(bad)))
    truth = {k: any(s in t for s in INSULTS) for k, t in docs}
    extra = [(5000, None), (5001, ""), (5002, "?!"), (None, "ba ti grobla"), (5003, "ba " * 100_000 + " snarfen"), (0, docs[0][1])]
    return (
        spark.createDataFrame([(k, t, 0.5, "own") for k, t in docs + extra], "doc_id bigint, text string, score double, toxic string"),
        spark.createDataFrame(labels + [(None, 1, 1), (1, None, None), (2, 1, 7), (3, 1, int(truth[3])), (3, 1, int(truth[3]))], "doc_id bigint, quality int, toxic int"),
        truth)


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit(tables[0], tables[1])


def test_held_out_accuracy(tables, model):
    docs, _, truth = tables
    rows = model.apply(docs).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("doc_id < 1500").collect()
    for held in (True, False):
        part = [r for r in rows if r["held"] == held]
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in part]) > 0.97
        caught = [r["predicted"] for r in part if truth[r["doc_id"]]]
        assert np.mean(caught) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_odd_rows_are_scored(tables, model):
    docs, _, _ = tables
    out = model.apply(docs)
    assert out.count() == docs.count() and set(out.columns) == {"doc_id", "text", "toxic", "score", "predicted"}
    rows = {r["doc_id"]: r["predicted"] for r in out.where("doc_id >= 5000 or doc_id is null").collect()}
    assert rows == {5000: 0, 5001: 0, 5002: 0, None: 1, 5003: 1}


def test_labels_of_the_held_out_fold_are_never_read(tables, model):
    docs, labels, _ = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert again.terms == model.terms and np.allclose(again.weights, model.weights)


def test_a_score_depends_on_the_text_only(tables, model):
    docs, _, _ = tables
    moved = docs.withColumn("doc_id", F.col("doc_id") * 7 + 1)
    a = sorted((r["text"] or "", round(r["score"], 12)) for r in model.apply(docs).collect())
    b = sorted((r["text"] or "", round(r["score"], 12)) for r in model.apply(moved.repartition(3)).collect())
    assert a == b


def test_without_labels_the_general_lexicon_decides(tables):
    docs, labels, _ = tables
    plain = toxicity.fit(docs, labels.where("false"))
    spark = docs.sparkSession
    rows = plain.apply(spark.createDataFrame([(1, "you idiot"), (2, "hello")], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["predicted"] for r in rows} == {1: 1, 2: 0}
    assert plain.apply(docs.where("false")).count() == 0 and toxicity.fit(docs.where("false"), labels).intercept < 0


def test_label_model_finds_hit_rates_and_correlations():
    draw, prior, n = np.random.default_rng(8), 0.2, 400_000
    y = draw.random(n) < prior
    hit = [(0.6, 0.02), (0.5, 0.01), (0.4, 0.03), (0.7, 0.05)]
    votes = [np.where(y, draw.random(n) < a, draw.random(n) < b) for a, b in hit]
    votes.append(votes[0])  # a voter that repeats another one
    bits = sum(v.astype(np.int64) << k for k, v in enumerate(votes))
    counts = {int(p): int(c) for p, c in zip(*np.unique(bits, return_counts=True))}
    rates, discounts = toxicity.label_model(counts, prior, {})
    for k in range(1, 4):
        assert abs(rates[k, 0] - hit[k][0]) < 0.06 and abs(rates[k, 1] - hit[k][1]) < 0.02
    assert discounts[0] < 0.8 and discounts[4] < 0.8 and min(discounts[1:4]) > 0.85
    assert toxicity.posterior(0b1110, prior, rates, discounts) > 0.99


def test_query(spark, sf):
    rows = QUERIES["op2_toxicity"](spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.85


def test_terms_are_taken_whatever_their_number(spark):
    """400 insults, each in few texts: a model of a fixed number of terms would not know them all."""
    insults = [f"zz{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + k * 7 % 26)}x" for k in range(400)]
    docs = [(k, f"ba ti {insults[k % 400]} ro") for k in range(2_800)] + [(10_000 + k, f"ba ti ro ne {k}") for k in range(3_000)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    rows = model.apply(docs).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] < 10_000) for r in rows]) > 0.96  # some insults have under four texts to learn from


def test_regression_equals_a_dense_solution():
    draw = np.random.default_rng(5)
    rows = [(sorted(draw.choice(12, draw.integers(0, 5), replace=False).tolist()), float(draw.random()), float(draw.integers(1, 4))) for _ in range(300)]
    beta, intercept = toxicity._regression(rows, 12)
    x = np.zeros((300, 13))
    x[:, 12] = 1
    for i, (found, _, _) in enumerate(rows):
        x[i, found] = 1
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    whole = np.append(beta, intercept)
    slope = x.T @ (w * (y - 1 / (1 + np.exp(-x @ whole)))) - np.append(np.full(12, 0.05), 1e-6) * whole
    assert np.abs(slope).max() < 1e-5


def test_a_repeated_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "grobla")] * 3_000 + [(k, f"ba {k}") for k in range(2, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 60)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.terms == ()
