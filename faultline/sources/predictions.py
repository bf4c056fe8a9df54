"""The stored predictions: dense ids, batches that can be rerun, a check after the write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from faultline import schema as S
from faultline.operators import monitor
from faultline.session import scratch_path, scratch_scope


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The whole table, batch partitions included."""
    return spark.read.schema(S.PREDICTIONS).parquet(path)


def dense_ids(stored: DataFrame, start: int = 0, name: str = "prediction_id") -> DataFrame:
    """Ids ``start + 1 .. start + rows`` for a frame read from parquet files.

    A row's file and its position there never change, whatever the splits and however
    often a task is rerun. Rows are counted per file; running sums, over groups of files and
    inside each group, give each file its offset. No row is sorted or moved to one task, and
    the join with the offsets is left to the optimiser.
    """
    located = stored.withColumn("__file", F.col("_metadata.file_path")).withColumn("__row", F.col("_metadata.row_index"))
    per_file = located.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__group", F.substring(F.md5("__file"), 1, 3))
    earlier = W.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    groups = per_file.groupBy(F.col("__group").alias("__g")).agg(F.sum("__n").alias("__sum")).select(
        "__g", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__group").orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_file.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(
        groups, F.col("__group") == F.col("__g")).select(
        F.col("__file").alias("__f"), (F.col("__before") + F.col("__inside")).alias("__offset"))
    number = (F.col("__offset") + F.col("__row") + 1 + start).cast("long").alias(name)
    return located.join(offsets, F.col("__file") == F.col("__f")).select(number, *(f"`{c}`" for c in stored.columns))


@dataclass(frozen=True)
class Range:
    """The ids of one write of a batch: ``first .. first + rows - 1``."""

    first: int
    rows: int
    batch_id: str


def id_range(spark: SparkSession, path: str, batch_id: str, rows: int) -> Range:
    """The ids of the next write of a batch: those it is stored under if it has as many rows, else new ones.

    New ids start behind the largest stored one. One aggregate over the id column of the
    stored table says all of that. Writers of one table take turns, or the table's format
    sees to conflicts: two writers at once would get the same ids.
    """
    from pyspark.errors import AnalysisException

    try:
        stored = read_predictions(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return Range(1, rows, batch_id)
        raise
    own = F.when(F.col("batch_id") == batch_id, F.col("prediction_id"))
    last, first, count = stored.agg(F.max("prediction_id"), F.min(own), F.count(own)).first()
    return Range(first if count and count == rows else (last or 0) + 1, rows, batch_id)


@dataclass(frozen=True)
class StoredBatch:
    """A batch as stored, its rows and the missing cells that were filled for it."""

    stored: DataFrame
    rows: int
    filled_cells: int


def store_batch(
    predictions: DataFrame, path: str, batch_id: str, created_at: Column | None = None, filled: str | None = None,
) -> StoredBatch:
    """Append one batch, check what was stored, and return it.

    The scored rows are written to scratch first, so ids are given to rows that can no
    longer change; rows and filled cells (the column ``filled``, per row) are counted there.
    The batch is one partition of the table: writing the same batch again replaces it under
    the same ids if it has as many rows. A job that fails before its commit leaves the table
    as it was; one that fails in the commit may leave the batch in part, and writing it
    again repairs that.
    """
    spark = predictions.sparkSession
    names = [f.name for f in S.PREDICTIONS]
    key = next((c for c in predictions.columns if c.lower() == S.ROW_KEY), None)
    with scratch_scope(spark):
        staged_path = scratch_path(spark, "scored")
        predictions.select(
            F.col("prediction").cast("int").alias("prediction"), "prediction_label",
            F.col("failure_probability").cast("double").alias("failure_probability"), "risk_level",
            (F.lit(None) if key is None else F.col(f"`{key}`")).cast("string").alias(S.ROW_KEY),
            (F.lit(0) if filled is None else F.col(filled)).cast("bigint").alias("__filled"),
        ).write.parquet(staged_path)
        staged = spark.read.parquet(staged_path)
        rows, cells = staged.agg(F.count(F.lit(1)), F.coalesce(F.sum("__filled"), F.lit(0))).collect()[0]
        ids = id_range(spark, path, batch_id, rows)
        stamp = created_at if created_at is not None else F.localtimestamp()
        numbered = dense_ids(staged.drop("__filled"), ids.first - 1)
        out = numbered.withColumn("created_at", stamp.cast("timestamp_ntz")).withColumn("batch_id", F.lit(batch_id))
        out.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch_id").parquet(path)
    stored = read_predictions(spark, path).filter(F.col("batch_id") == batch_id)
    verify_batch(stored, rows)
    return StoredBatch(stored, rows, cells)


def append_predictions(
    predictions: DataFrame, path: str, batch_id: str, created_at: Column | None = None,
) -> DataFrame:
    """``store_batch`` for frames without filled cells: the batch as stored."""
    return store_batch(predictions, path, batch_id, created_at).stored


def verify_batch(stored: DataFrame, expected: int) -> None:
    """After a write: all rows are there, their ids are dense, no row lacks a score."""
    row = stored.agg(
        F.count(F.lit(1)).alias("rows"), F.min("prediction_id").alias("first"), F.max("prediction_id").alias("last"),
        F.sum(F.col("prediction_id").cast("decimal(38,0)")).alias("ids"),
        F.count_if(F.col("failure_probability").isNull() | F.col("prediction").isNull() | F.col("risk_level").isNull()).alias("empty"),
    ).collect()[0]
    if row["rows"] != expected:
        raise RuntimeError(f"{row['rows']} rows stored, {expected} expected")
    if expected and (row["last"] - row["first"] + 1 != expected or 2 * int(row["ids"]) != (row["first"] + row["last"]) * expected):
        raise RuntimeError("stored ids are not dense")
    if row["empty"]:
        raise RuntimeError(f"{row['empty']} stored rows without score or risk")


def verify_predictions(predictions: DataFrame, newest: int = 10) -> dict[str, DataFrame]:
    """Of a stored table: total rows, rows per risk level, the newest rows."""
    return {
        "total_rows": monitor.total_rows(predictions),
        "risk_counts": monitor.risk_counts(predictions),
        "latest": monitor.latest_predictions(predictions, newest),
    }
