"""Merged states against a whole rescan."""

import tempfile

import pytest
from pyspark.sql import functions as F

from faultline.operators import quality

COLUMNS = ["a", "b", "few", "gaps", "empty"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(60_000).select(
        (F.col("id") % 5).cast("string").alias("batch"), (F.hash("id") / 7.0).alias("a"), F.col("id").cast("double").alias("b"),
        (F.col("id") % 3 - 1).cast("int").alias("few"),
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("id") * 1.0).alias("gaps"),
        F.lit(None).cast("double").alias("empty")).repartition(6)


@pytest.fixture(scope="module")
def states(spark, frame):
    path = tempfile.mkdtemp(prefix="run-") + "/states"
    for k in ("0", "1", "2", "3", "4", "2"):
        quality.store_state(quality.batch_state(frame.where(F.col("batch") == k), COLUMNS), path, k)
    return quality.read_states(spark, path)


@pytest.mark.parametrize("first, last", [("0", "4"), ("1", "3"), ("2", "2")])
def test_a_span_equals_a_rescan(frame, states, first, last):
    assert states.count() == 25
    rows = frame.where(F.col("batch").between(first, last))
    got = {r["column_name"]: r for r in quality.span(states, first, last).collect()}
    for c in COLUMNS:
        v = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        n, known, zeros, low, high, distinct = rows.agg(
            F.count(F.lit(1)), F.count(v), F.count_if(v == 0), F.min(v), F.max(v), F.countDistinct(v)).first()
        r = got[c]
        assert (r["row_count"], r["missing_count"], r["zero_count"], r["minimum"], r["maximum"]) == (n, n - known, zeros, low, high)
        assert abs(r["distinct_count"] - distinct) <= 4 * 1.04 / 2 ** 6 * distinct
        for q, name in zip(quality.QUARTILES, ("lower_quartile", "median", "upper_quartile")):
            if not known:
                assert r[name] is None
                continue
            below, upto = rows.agg(F.count_if(v < r[name]), F.count_if(v <= r[name])).first()
            assert below / known - 0.03 <= q <= upto / known + 0.03


def test_states_merge_in_any_order(states):
    whole = quality.report(quality.merged(states)).drop("lower_quartile", "median", "upper_quartile")
    halves = quality.merged(states.where("batch_id < '2'")).unionByName(quality.merged(states.where("batch_id >= '2'")))
    again = quality.report(quality.merged(halves)).drop("lower_quartile", "median", "upper_quartile")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.select(*whole.columns).collect()))


def test_changes_between_batches(spark, frame):
    path = tempfile.mkdtemp(prefix="run-") + "/states"
    batches = {
        "1": frame, "2": frame, "3": frame.withColumn("a", F.when(F.rand(1) < 0.2, None).otherwise(F.col("a"))),
        "4": frame.withColumn("b", F.col("b") + 50_000), "5": frame.where("false")}
    for k, rows in batches.items():
        quality.store_state(quality.batch_state(rows, COLUMNS), path, k)
    got = {(r["batch_id"], r["column_name"]): r["flags"] for r in quality.changes(quality.read_states(spark, path)).collect()}
    flagged = {k: v for k, v in got.items() if v and k[1] != "empty" and k[0] not in "45"}
    assert flagged == {("3", "a"): ["missing"]}
    assert got["4", "b"] == ["median", "range"] and "missing" in got["4", "a"]
    assert got["5", "few"] == ["empty"] and got["1", "empty"] == ["empty"] and len(got) == 25
