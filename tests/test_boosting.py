"""Second-order boosting against a plain booster over every cut of every node."""

import dataclasses
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import boosting, explain, scoring
from faultline.sources import models as store

FEATURES = ["a", "b", "c", "d"]
SMALL = boosting.Params(rounds=4, depth=3, step=0.3, row_share=1.0, feature_share=1.0)


def _data(n=500):
    draw = np.random.default_rng(5)
    x = np.column_stack([
        draw.normal(size=n).round(1), draw.exponential(size=n).round(1), draw.integers(0, 4, n).astype(float), np.full(n, 7.0)])
    y = (x[:, 0] + 0.7 * x[:, 1] - 0.4 * x[:, 2] + draw.normal(size=n) > 1.2).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark):
    x, y = _data()
    rows = [(f"k{i}", *map(float, x[i]), int(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "row_key string, a double, b double, c double, d double, label int").repartition(3).cache()


def _plain_leaf(g, h, p):
    return -math.copysign(max(abs(g) - p.alpha, 0.0), g) / (h + p.lambda_)


def _plain_tree(x, g, h, p, depth, out, rows):
    """Adds the tree's values to ``out``; returns its leaves as (value, hessian)."""
    def quality(a, b):
        return max(abs(a) - p.alpha, 0.0) ** 2 / (b + p.lambda_)

    best = (0.0, None)
    if depth:
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= cut]
                right = rows[x[rows, j] > cut]
                if min(h[left].sum(), h[right].sum()) < p.child_weight:
                    continue
                gain = quality(g[left].sum(), h[left].sum()) + quality(g[right].sum(), h[right].sum()) - quality(g[rows].sum(), h[rows].sum())
                if gain > best[0] + 1e-9 and gain >= p.gamma:
                    best = (gain, (left, right))
    if best[1] is None:
        value = p.step * _plain_leaf(g[rows].sum(), h[rows].sum(), p)
        out[rows] += value
        return [(value, h[rows].sum())]
    return [leaf for side in best[1] for leaf in _plain_tree(x, g, h, p, depth - 1, out, side)]


def _plain(x, y, w, p):
    margin, trees = np.full(len(y), p.base), []
    for _ in range(p.rounds):
        probability = 1 / (1 + np.exp(-margin))
        trees.append(_plain_tree(
            x, w * (probability - y), w * probability * (1 - probability), p, p.depth, margin, np.arange(len(y))))
    return margin, trees


def _margins(model):
    x, _ = _data()
    return model.margins(x.T)


def _leaves(model):
    return [[(v, c) for f, v, c in zip(t.feature, t.value, t.cover) if f < 0] for t in model.trees]


@pytest.mark.parametrize("settings, weighted", [
    ({}, False), ({"gamma": 2.0}, False), ({"alpha": 4.0}, False), ({"lambda_": 20.0}, False), ({"child_weight": 12.0}, False),
    ({"gamma": 0.1, "alpha": 0.1, "lambda_": 1.0, "child_weight": 3.0, "base": -0.4}, True)])
def test_equals_the_plain_booster(frame, settings, weighted):
    p = dataclasses.replace(SMALL, **settings)
    x, y = _data()
    w = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0) if weighted else np.ones(len(y))
    margin, trees = _plain(x, y, w, p)
    model = scoring.train_second_order(frame, FEATURES, params=p, weighted=weighted)
    assert np.allclose(_margins(model), margin, atol=1e-9)
    for mine, plain in zip(_leaves(model), trees):
        assert np.allclose(sorted(mine), sorted(plain), atol=1e-9)


def test_each_penalty_acts(frame):
    plain = dataclasses.replace(SMALL, rounds=1, child_weight=0.0, lambda_=0.0)
    free = _leaves(boosting.fit(frame, FEATURES, params=plain))[0]
    leaves = {
        name: _leaves(boosting.fit(frame, FEATURES, params=dataclasses.replace(plain, **{name: value})))[0]
        for name, value in (("gamma", 15.0), ("alpha", 6.0), ("lambda_", 30.0), ("child_weight", 25.0))}
    assert 1 < len(leaves["gamma"]) < len(free)
    assert max(abs(v) for v, _ in leaves["lambda_"]) < max(abs(v) for v, _ in free)
    assert sum(abs(v) * h for v, h in leaves["alpha"]) < sum(abs(v) * h for v, h in free)
    assert min(h for _, h in leaves["child_weight"]) >= 25.0 > min(h for _, h in free)


def test_loss_falls_and_drawn_features_and_rows_differ(frame):
    model = boosting.fit(frame, FEATURES, params=dataclasses.replace(SMALL, rounds=12, step=0.1))
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    x, y = _data()
    margin = _margins(model)
    assert np.logaddexp(0, np.where(y == 1, -margin, margin)).mean() < model.losses[-1]
    drawn = boosting.fit(frame, FEATURES, params=dataclasses.replace(SMALL, rounds=8, row_share=0.5, feature_share=0.5), key="row_key")
    used = [{f for f in t.feature if f >= 0} for t in drawn.trees]
    assert all(len(u) <= 2 for u in used) and len(set(map(frozenset, used))) > 1
    totals = [t.cover[0] for t in drawn.trees]
    assert all(0.3 < c / model.trees[0].cover[0] < 0.7 for c in totals[:1])


def test_the_model_does_not_depend_on_partitions(frame):
    p = dataclasses.replace(SMALL, rounds=3, row_share=0.7, feature_share=0.8)
    one = boosting.fit(frame.repartition(1), FEATURES, params=p, key="row_key")
    many = boosting.fit(frame.repartition(7, "row_key"), FEATURES, params=p, key="row_key")
    assert [t.feature for t in one.trees] == [t.feature for t in many.trees]
    assert np.allclose(_margins(one), _margins(many), atol=1e-12)


def test_blocks_written_anew_change_nothing(frame, monkeypatch):
    p = dataclasses.replace(SMALL, rounds=5)
    before = _margins(boosting.fit(frame, FEATURES, params=p))
    monkeypatch.setattr(boosting, "REWRITE", 2)
    assert np.allclose(_margins(boosting.fit(frame, FEATURES, params=p)), before, atol=1e-12)


def test_few_bins_take_their_cuts_from_the_ranks(spark):
    rows = spark.range(10_000).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    a, b = boosting.fit_cuts(rows, ["a", "b"], 8)
    assert len(a) == 7 and np.abs(a - np.arange(1, 8) * 1250).max() < 60 and b.tolist() == [0.0, 1.0]


def test_scores_store_and_contributions(spark, frame):
    model = scoring.train_second_order_weighted(frame, FEATURES, params=dataclasses.replace(boosting.WEIGHTED, rounds=3, depth=3), key="row_key")
    path = tempfile.mkdtemp(prefix="run-") + "/model"
    store.save_model(model, path)
    copy, features = store.load_model(path)
    assert features == FEATURES
    scored = scoring.score(copy, frame.withColumn("prediction", F.lit("x")))
    got = {r["row_key"]: r for r in scored.collect()}
    x, y = _data()
    want = 1 / (1 + np.exp(-_margins(model)))
    assert all(got[f"k{i}"]["failure_probability"] == pytest.approx(want[i], abs=1e-12) for i in range(len(y)))
    assert all(r["prediction"] == int(r["failure_probability"] >= 0.5) for r in got.values())
    for r in explain.tree_shap(copy, scored, ["failure_probability"]).collect():
        p = r["failure_probability"]
        assert r["base_value"] + sum(r[explain.PHI]) == pytest.approx(math.log(p / (1 - p)), abs=1e-9)


def test_rows_that_cannot_be_trained_on(spark, frame):
    for bad, message in (
            (frame.withColumn("b", F.when(F.col("c") == 1, None).otherwise(F.col("b"))), "missing cells"),
            (frame.withColumn("b", F.lit(float("nan"))), "missing cells"), (frame.where("label = 0"), "one class"),
            (frame.where("false"), "one class"), (frame.withColumn("label", F.lit(2)), "0 or 1"),
            (frame.withColumn("label", F.lit(None).cast("int")), "0 or 1")):
        with pytest.raises(ValueError, match=message):
            boosting.fit(bad, FEATURES, params=SMALL)
    with pytest.raises(Exception, match="a feature is missing"):
        scoring.score(boosting.BoostedTrees(("a",), 0.0, ()), spark.range(3).select(F.lit(None).cast("double").alias("a"))).collect()


def test_blocks_lie_in_as_many_files_as_cores_can_read(spark, monkeypatch):
    """Rows of two sizes: few lie in one file, more in several, and a worker meets few blocks at once."""
    sizes, batches = [], []
    write, counted = boosting.write_stage, boosting._counted
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def written(df, path):
        done = write(df, path)
        sizes.append(len(done.inputFiles()))
        return done

    def seen(blocks, *rest):
        batches.append(blocks.sparkSession.conf.get(key))
        return counted(blocks, *rest)

    monkeypatch.setattr(boosting, "write_stage", written)
    monkeypatch.setattr(boosting, "_counted", seen)
    before = spark.conf.get(key)
    for rows in (1_000, 200_000):
        df = spark.range(0, rows, numPartitions=30).selectExpr("id", "double(id % 11) AS a", "int(id % 11 > 5) AS label")
        boosting.fit(df, ["a"], params=boosting.Params(rounds=1, depth=1), key="id")
    assert sizes == [1, 4] and set(batches) == {"8"} and spark.conf.get(key) == before
