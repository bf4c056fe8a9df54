"""Trees grown by several tasks against those of one, restarts, and cuts of many values."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.operators import boosting, growing

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    n = 3_000
    x = np.column_stack([draw.integers(0, 40, n), draw.integers(0, 9, n) / 4, draw.normal(size=n).round(1)])
    y = (x[:, 0] / 20 + x[:, 1] - x[:, 2] + draw.normal(size=n) > 3.0).astype(int)
    frame = pd.DataFrame(x.astype(float), columns=FEATURES).assign(label=y, row_key=[f"k{i}" for i in range(n)])
    return spark.createDataFrame(frame).repartition(5).cache()


def test_tasks_that_share_the_rows_grow_the_trees_of_one_task(rows, monkeypatch):
    params = boosting.Params(rounds=7, depth=4, step=0.3)
    one = boosting.fit(rows, FEATURES, params=params, key="row_key")
    monkeypatch.setattr(boosting, "TASK_ROWS", 500)
    many = boosting.fit(rows, FEATURES, params=params, key="row_key")
    assert [t.feature for t in one.trees] == [t.feature for t in many.trees]
    assert all(np.allclose(a.value, b.value, atol=1e-12) and np.allclose(a.cover, b.cover) for a, b in zip(one.trees, many.trees))
    assert np.allclose(one.losses, many.losses, atol=1e-12)


def _blocks(features, n):
    draw = np.random.default_rng(0)
    bins = draw.integers(0, 8, (features, n)).astype(np.uint8)
    label = (bins[0] > draw.integers(0, 8, n)).astype(float)
    parts = [bins, label, np.ones(n), np.arange(n), np.zeros(n)]
    return pa.RecordBatch.from_arrays(
        [pa.array([p.tobytes()], pa.binary()) for p in parts], names=["bins", "label", "weight", "row", "margin"])


def test_a_stage_that_runs_again_goes_on_from_the_stored_trees(tmp_path):
    objective = boosting._SecondOrder(boosting.Params(rounds=6, depth=3, bins=8))
    cuts = [np.arange(7.0)] * 3

    def grow(folder, attempt, save_every):
        return growing._grow([_blocks(3, 400)], growing._Together(str(folder), 0, 1, attempt), objective, cuts, save_every)

    whole, losses = grow(tmp_path / "a", "1", 100)
    grow(tmp_path / "b", "1", 4)
    assert (tmp_path / "b" / "trees-4").exists()
    started = []
    tree = growing._tree
    growing._tree = lambda *x: started.append(x[-1]) or tree(*x)
    try:
        again, repeated = grow(tmp_path / "b", "2", 4)
    finally:
        growing._tree = tree
    assert started == [4, 5]
    assert [g.tree for g in again] == [g.tree for g in whole] and repeated == losses


def test_cuts_of_many_values_lie_at_their_ranks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SUMMARY_ROWS", 20_000)
    df = spark.range(0, 300_000, numPartitions=3).select(
        ((F.col("id") * 7919) % 300_000).cast("double").alias("a"), F.exp((F.col("id") % 1000) / 100.0).alias("b"), F.lit(1.0).alias("c"))
    a, b, c = boosting.fit_cuts(df, ["a", "b", "c"], 64)
    assert len(a) == 63 and np.abs(a - np.arange(1, 64) * 300_000 / 64).max() < 300_000 / 64 / 8
    assert len(b) == 63 and np.abs(np.log(b) * 100 - np.arange(1, 64) * 1000 / 64).max() < 2 and len(c) == 0
    values = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "a double")
    assert boosting.fit_cuts(values, ["a"], 8, True)[0].tolist() == [float("-inf"), 1.5, 2.0]
