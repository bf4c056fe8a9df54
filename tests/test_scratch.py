"""Stages are deleted when their consumer has finished, by an error too."""

import glob
import os
import tempfile

import pytest

from faultline import fixtures
from faultline.operators import explain, scoring
from faultline.plans import models as plans
from faultline.plans.preprocess import preprocess
from faultline.session import scratch_root, scratch_scope
from faultline.sources import models as store, predictions, tables
from faultline.streaming import scoring as streaming

FEATURES = ["aa_000", "bj_000"]


def _stages(spark):
    return set(glob.glob(os.path.join(scratch_root(spark), "faultline", "*")))


@pytest.fixture(scope="module")
def model(spark, sf):
    rows = plans.labelled(fixtures.sensor_raw(spark, sf, key=True), FEATURES)
    path = tempfile.mkdtemp(prefix="run-") + "/model"
    store.save_model(scoring.train_boosted(rows, FEATURES, params=scoring.BoostParams(rounds=2, depth=2)), path)
    return path


def test_preparation_leaves_nothing(spark, sf):
    before = _stages(spark)
    target = tempfile.mkdtemp(prefix="run-") + "/out"
    with scratch_scope(spark):
        tables.write_processed(preprocess(fixtures.sensor_raw(spark, sf, key=True)).data, target)
        assert _stages(spark) > before
    assert _stages(spark) == before and spark.read.parquet(target).count() > 0


def test_an_error_leaves_nothing(spark, sf):
    before = _stages(spark)
    with pytest.raises(RuntimeError), scratch_scope(spark):
        preprocess(fixtures.sensor_raw(spark, sf))
        raise RuntimeError
    assert _stages(spark) == before


def test_a_batch_and_a_stream_leave_nothing(spark, sf, model):
    before = _stages(spark)
    root = tempfile.mkdtemp(prefix="run-")
    source = fixtures.sensor_raw(spark, sf, key=True)
    done = plans.batch_score(source, model, root + "/table", "one")
    assert done.rows == source.count() and done.filled_cells == 0
    run = streaming.score_stream(fixtures.sensor_stream(spark, sf), model, root + "/stream", root + "/state")
    run.awaitTermination()
    explain.tree_table(store.load_model(model)[0])
    assert _stages(spark) == before


def test_reruns_keep_their_ids(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/table"
    rows = spark.range(300).selectExpr(
        "1 as prediction", "'FAILURE' as prediction_label", "0.9 as failure_probability", "'HIGH' as risk_level", "cast(id as string) as Row_Key")
    parts = {"a": rows.where("id < 100"), "b": rows.where("id >= 100"), "none": rows.where("id < 0")}
    for batch in ("a", "none", "b", "a", "none", "b", "a"):
        predictions.append_predictions(parts[batch], path, batch)
    stored = predictions.read_predictions(spark, path)
    ids = {r["batch_id"]: (r["lo"], r["hi"]) for r in stored.groupBy("batch_id").agg(
        {"prediction_id": "min", "created_at": "count"}).selectExpr("batch_id", "`min(prediction_id)` lo", "`count(created_at)` hi").collect()}
    assert ids == {"a": (1, 100), "b": (101, 200)} and stored.where("row_key is null").count() == 0
    predictions.append_predictions(rows.where("id < 50"), path, "a")
    moved = predictions.read_predictions(spark, path).where("batch_id = 'a'").selectExpr("min(prediction_id)", "max(prediction_id)").first()
    assert tuple(moved) == (301, 350)


def test_id_ranges_come_from_the_stored_table(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/table"
    assert predictions.id_range(spark, path, "a", 10) == predictions.Range(1, 10, "a")
    rows = spark.range(30).selectExpr(
        "1 as prediction", "'FAILURE' as prediction_label", "0.9 as failure_probability", "'HIGH' as risk_level")
    for batch in ("a", "b"):
        predictions.append_predictions(rows, path, batch)
    first = {(b, n): predictions.id_range(spark, path, b, n).first for b in ("a", "b", "c") for n in (0, 30, 31)}
    assert first == {(b, n): {("a", 30): 1, ("b", 30): 31}.get((b, n), 61) for b in ("a", "b", "c") for n in (0, 30, 31)}


def test_a_stored_batch_is_checked(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, "LOW"), (3, 1, 0.5, "LOW")], "prediction_id bigint, prediction int, failure_probability double, risk_level string")
    with pytest.raises(RuntimeError, match="2 rows stored"):
        predictions.verify_batch(rows, 3)
    with pytest.raises(RuntimeError, match="dense"):
        predictions.verify_batch(rows, 2)
    with pytest.raises(RuntimeError, match="without score"):
        predictions.verify_batch(rows.where("prediction_id = 1").selectExpr("prediction_id", "prediction", "null as failure_probability", "risk_level"), 1)
