from pyspark.sql import functions as F

from faultline.functions import expressions as X
from faultline.operators import monitor, scoring

SCHEMA = ("prediction_id long, prediction int, prediction_label string, failure_probability double, "
          "risk_level string, created_at timestamp_ntz")


def _frame(spark, probabilities):
    df = spark.createDataFrame([(i + 1, p) for i, p in enumerate(probabilities)], "prediction_id long, failure_probability double")
    scored = df.withColumn("prediction", X.threshold_label("failure_probability"))
    return scoring.prediction_frame(scored, ["prediction_id"]).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))


def test_empty_sums_are_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = monitor.monitoring_summary(empty).collect()[0]
    assert row["total_predictions"] == 0 and row["predicted_failures"] is None and row["high_risk_percentage"] is None
    assert monitor.dashboard_kpis(empty).collect()[0]["critical_count"] is None
    assert monitor.risk_distribution(empty).count() == 0


def test_counts_by_number_and_by_label_agree(spark):
    df = _frame(spark, [0.1, 0.3, 0.5, 0.7, 0.8, 0.95, None])
    by_number, by_label = monitor.monitoring_summary(df).collect()[0], monitor.dashboard_summary(df).collect()[0]
    assert by_number["predicted_failures"] == by_label["predicted_failures"] == 4
    parts = [by_label[f"{n}_count"] for n in ("critical", "urgent", "monitor", "normal")]
    assert parts == [1, 1, 2, 3] and by_label["action_required_percentage"] == 28.57


def test_custom_order_and_shares(spark):
    df = _frame(spark, [0.9] * 3 + [0.4] * 2 + [0.1] * 4)
    rows = [tuple(r) for r in monitor.risk_distribution(df).collect()]
    assert rows == [("HIGH", 3, 33.33), ("MEDIUM", 2, 22.22), ("LOW", 4, 44.44)]


def test_ties_go_by_id(spark):
    df = _frame(spark, [0.9] * 30)
    assert [r["prediction_id"] for r in monitor.top_high_risk(df).collect()] == list(range(1, 21))
    assert [r["prediction_id"] for r in monitor.latest_predictions(df).collect()] == list(range(30, 20, -1))


def test_summary_does_not_read_the_action_text(spark):
    plan = monitor.dashboard_summary(_frame(spark, [0.5]))._jdf.queryExecution().optimizedPlan().toString()
    assert "recommended_action" not in plan
