"""Tables, stages and small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline import schema as S
from faultline.operators import monitor
from faultline.session import scratch_path


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A parquet path (it holds a slash), or a catalog table or view, whole."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_features(
    spark: SparkSession, name: str, features: Sequence[str] = S.TOP_FEATURES, target: str = "CLASS",
) -> DataFrame:
    """Only the features and the target; the scan reads no other column."""
    return read_table(spark, name).select(*(F.col(c).alias(c) for c in (*features, target)))


def read_column(df: DataFrame, column: str = S.CLASS) -> DataFrame:
    return df.select(column)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage and continue from what was written: lineage is cut, types are kept."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """A stage in the shared scratch folder."""
    return write_stage(df, scratch_path(df.sparkSession, name))


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The processed dataset; CSV keeps a header per part file."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_small(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One file for a table that is small by construction: thresholds, features, one row's explanation."""
    write_processed(df.coalesce(1), path, fmt)


def append_metrics(
    metrics: DataFrame, path: str, *, run_id: str, model: str, dataset: str, train_rows: int, features: int,
) -> None:
    """One run's scores, a row per metric, in the run history; writing a run again replaces it.

    ``metrics`` is the one-row frame of the evaluation; its ``test_rows`` is kept.
    """
    measures = [c for c in metrics.columns if c != "test_rows"]
    rows = metrics.select(
        F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), F.lit(dataset).alias("dataset"),
        F.lit(train_rows).cast("long").alias("train_rows"), F.col("test_rows").cast("long").alias("test_rows"),
        F.lit(features).cast("int").alias("features"),
        F.inline(F.array(*(
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures))),
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.METRICS).parquet(path).select(*S.METRICS.names)


def register_views(predictions: DataFrame) -> tuple[str, ...]:
    """The monitoring views over the stored predictions, for SQL: summary, risks, priorities, actions, dashboard.

    They live as long as the session and read the table whenever they are queried.
    """
    # The names that existing SQL reads.
    views = {
        "APS_FAILURE_MONITORING_SUMMARY": monitor.monitoring_summary, "APS_FAILURE_RISK_DISTRIBUTION": monitor.risk_distribution,
        "APS_FAILURE_HIGH_RISK": monitor.high_risk, "APS_FAILURE_MAINTENANCE_PRIORITY": monitor.maintenance_priority,
        "APS_FAILURE_MAINTENANCE_ACTIONS": monitor.maintenance_actions, "APS_FAILURE_DASHBOARD": monitor.dashboard_summary,
    }
    for name, frame in views.items():
        frame(predictions).createOrReplaceTempView(name)
    return tuple(views)
