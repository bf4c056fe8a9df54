"""Model performance where labels come late, by period of prediction.

A prediction waits for its label for a stated time. It is counted when the label arrives, or as
unlabelled when its time has passed; later labels change nothing. The same plan serves stored
tables and streams: on a stream both sides carry a watermark, the join keeps a row only until
its time is up, and a period is final once no row of it can change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import schema as S

P = "failure_probability"


def with_late_labels(
    predictions: DataFrame, labels: DataFrame, key: str = S.ROW_KEY, delay: str = "2 days", late: str = "1 hour",
    predicted_at: str = "created_at", labelled_at: str = "labelled_at", label: str = "label",
) -> DataFrame:
    """Predictions (key, created_at, failure_probability, prediction) with the label that came in time, or null.

    A label counts for the predictions of its key made at most ``delay`` before it, and not
    after it. ``labels`` has a row per key and time; of several in time each counts. Null keys
    have no label. On streams rows later than ``late`` behind the newest are dropped.
    """
    made = predictions.select(
        F.col(key).alias("__key"), F.col(predicted_at).cast("timestamp").alias("created_at"), P, "prediction")
    said = labels.select(
        F.col(key).alias("__label_key"), F.col(labelled_at).cast("timestamp").alias("labelled_at"), F.col(label).alias("label"))
    if made.isStreaming:
        made, said = made.withWatermark("created_at", late), said.withWatermark("labelled_at", late)
    in_time = (F.col("labelled_at") >= F.col("created_at")) & (F.col("labelled_at") <= F.col("created_at") + F.expr(f"interval {delay}"))
    return made.join(said, (F.col("__key") == F.col("__label_key")) & in_time, "left").select(
        F.col("__key").alias(key), "created_at", P, "prediction", "label")


def _rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def performance(labelled: DataFrame, every: str = "1 day") -> DataFrame:
    """Per period of prediction: rows, labelled and unlabelled ones, the four counts, precision, recall and Brier score.

    Measures are over labelled rows; those without a base are null. Rows without a score are
    counted and take no part in the measures.
    """
    known = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    said, true = F.col("prediction") == 1, F.col("label") == 1
    period = F.window("created_at", every)
    counts = labelled.groupBy(period).agg(
        F.count(F.lit(1)).alias("predictions"), F.count("label").alias("labelled"),
        F.count_if(known & said & true).alias("true_positives"), F.count_if(known & said & ~true).alias("false_positives"),
        F.count_if(known & ~said & true).alias("false_negatives"), F.count_if(known & ~said & ~true).alias("true_negatives"),
        F.avg(F.when(known, F.pow(F.col(P) - F.col("label"), 2))).alias("brier"))
    hits, wrong, lost = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return counts.select(
        F.col("window.start").cast("timestamp_ntz").alias("period_start"), F.col("window.end").cast("timestamp_ntz").alias("period_end"),
        "predictions", "labelled", (F.col("predictions") - F.col("labelled")).alias("unlabelled"),
        "true_positives", "false_positives", "false_negatives", "true_negatives",
        _rate(hits, hits + wrong).alias("precision"), _rate(hits, hits + lost).alias("recall"), "brier")


def settled(performance_rows: DataFrame, until: Column, delay: str = "2 days") -> DataFrame:
    """Of a stored table's periods those that no label after ``until`` can change."""
    return performance_rows.where(F.col("period_end") + F.expr(f"interval {delay}") <= until)
