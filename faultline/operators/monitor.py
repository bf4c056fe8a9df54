"""Risk, priority, actions and the monitoring summaries over stored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.functions import expressions as X

P = "failure_probability"
RISK_ORDER = ("HIGH", "MEDIUM", "LOW")
_DISPLAY = ("prediction_id", "prediction_label", P, "risk_level", "created_at")


def _count(test: Column) -> Column:
    """SUM(CASE): null, not 0, on empty input."""
    return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")


def _mean_probability() -> Column:
    return F.round(F.avg(P), 4)


def high_risk(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("risk_level") == "HIGH").select(*_DISPLAY)


def maintenance_priority(predictions: DataFrame) -> DataFrame:
    priority = X.maintenance_priority(P).alias("maintenance_priority")
    return predictions.select(*_DISPLAY[:4], priority, "created_at")


def maintenance_actions(predictions: DataFrame) -> DataFrame:
    action = X.recommended_action("maintenance_priority").alias("recommended_action")
    ranked = maintenance_priority(predictions)
    return ranked.select(*_DISPLAY[:4], "maintenance_priority", action, "created_at")


def monitoring_summary(predictions: DataFrame) -> DataFrame:
    """One row of totals, counted by the numeric prediction."""
    risk = F.col("risk_level")
    return predictions.agg(
        F.count("*").alias("total_predictions"),
        _count(F.col("prediction") == 1).alias("predicted_failures"),
        _count(F.col("prediction") == 0).alias("predicted_non_failures"),
        _mean_probability().alias("avg_failure_probability"),
        _count(risk == "HIGH").alias("high_risk_count"),
        _count(risk == "MEDIUM").alias("medium_risk_count"),
        _count(risk == "LOW").alias("low_risk_count"),
        X.percent(_count(risk == "HIGH"), F.count("*")).alias("high_risk_percentage"),
    )


def dashboard_summary(predictions: DataFrame) -> DataFrame:
    """One row of totals over the actions, counted by the prediction label."""
    priority, label = F.col("maintenance_priority"), F.col("prediction_label")
    urgent = priority.isin("CRITICAL", "URGENT")
    return maintenance_actions(predictions).agg(
        F.count("*").alias("total_predictions"),
        _count(label == "FAILURE").alias("predicted_failures"),
        _count(label == "NO_FAILURE").alias("predicted_non_failures"),
        _mean_probability().alias("avg_failure_probability"),
        *(_count(priority == name).alias(f"{name.lower()}_count")
          for name in ("CRITICAL", "URGENT", "MONITOR", "NORMAL")),
        X.percent(_count(urgent), F.count("*")).alias("action_required_percentage"),
    )


def dashboard_kpis(predictions: DataFrame) -> DataFrame:
    """The summary row with the types a dashboard tile reads."""
    summary = dashboard_summary(predictions)
    real = ("avg_failure_probability", "action_required_percentage")
    return summary.select(*(
        F.col(c).cast("double" if c in real else "bigint").alias(c) for c in summary.columns
    ))


def total_rows(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("total_rows"))


def risk_counts(predictions: DataFrame) -> DataFrame:
    counts = predictions.groupBy("risk_level").agg(F.count("*").alias("row_count"))
    return counts.orderBy("risk_level")


def share_of_total(df: DataFrame, key: str, count_name: str = "row_count", digits: int = 2) -> DataFrame:
    """Rows per key and their share of all rows, whose number is a scalar beside the groups."""
    counts = df.groupBy(key).agg(F.count("*").alias(count_name))
    whole = counts.agg(F.sum(count_name)).scalar()
    return counts.withColumn("percentage", X.percent(F.col(count_name), whole, digits))


def risk_distribution(predictions: DataFrame, position: str | None = None) -> DataFrame:
    shares = share_of_total(predictions, "risk_level", "prediction_count")
    return order_by_label(shares, "risk_level", RISK_ORDER, position)


def order_by_label(df: DataFrame, column: str, order=RISK_ORDER, position: str | None = None) -> DataFrame:
    """Sorted by a custom order of labels; ``position`` adds the 1-based place as a column."""
    keys = (X.ordered_rank(column, order), F.col(column))
    if position is not None:
        df = df.withColumn(position, F.row_number().over(W.orderBy(*keys)))
    return df.orderBy(*keys)


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Totals, mean probability and rows per risk level as (metric, value) rows."""
    risk = F.col("risk_level")
    one = predictions.agg(
        F.count("*").cast("double").alias("total_predictions"),
        F.count_if(F.col("prediction") == 1).cast("double").alias("predicted_failures"),
        F.count_if(F.col("prediction") == 0).cast("double").alias("predicted_non_failures"),
        F.round(F.avg(P), 4).alias("average_probability"),
        *(F.count_if(risk == r).cast("double").alias(f"risk_{r.lower()}") for r in RISK_ORDER),
    )
    return one.unpivot([], one.columns, "metric", "value")


def _top(df: DataFrame, n: int) -> DataFrame:
    """Highest probability first; the id decides ties, so the result is determined."""
    return df.orderBy(F.desc(P), F.asc("prediction_id")).limit(n)


def top_high_risk(predictions: DataFrame, n: int = 20) -> DataFrame:
    return _top(high_risk(predictions), n)


def top_actions(predictions: DataFrame, n: int = 20) -> DataFrame:
    return _top(maintenance_actions(predictions), n)


def latest_predictions(predictions: DataFrame, n: int = 10) -> DataFrame:
    return predictions.select(*_DISPLAY).orderBy(F.desc("prediction_id")).limit(n)


def with_percent_text(df: DataFrame, column: str = P) -> DataFrame:
    """Keep the number and add its display form."""
    return df.withColumn(f"{column}_text", X.format_percent(column))


def prediction_trends(predictions: DataFrame, every: str = "1 day") -> DataFrame:
    """Predictions, failures, high risks and mean probability per period of creation.

    Works on a stream too, once it carries a watermark on ``created_at``.
    """
    period = F.window("created_at", every)
    return predictions.groupBy(period).agg(
        F.count("*").alias("total_predictions"),
        F.count_if(F.col("prediction") == 1).alias("predicted_failures"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_count"),
        _mean_probability().alias("avg_failure_probability"),
    ).select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"),
             "total_predictions", "predicted_failures", "high_risk_count", "avg_failure_probability")
