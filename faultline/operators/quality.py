"""Data quality over time from stored states: rows are read once, when their batch arrives.

The state of a batch has a row per column: counts, extremes, a sketch of distinct values and a
sketch of ranks. States merge, so any span of batches is answered from them alone, whatever the
rows were. A batch is one partition of the state table and replaced as a whole when it is
written again.

Distinct counts are estimates with a relative deviation of about ``1.04 / sqrt(2 ** DISTINCT_BITS)``;
quantiles have the rank that was asked for within about 1.7 hundredths of the rows (k = 200).
Counts and extremes are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

DISTINCT_BITS, RANK_K = 12, 200
QUARTILES = (0.25, 0.5, 0.75)
_COUNTS = ("row_count", "missing_count", "zero_count")
SCHEMA = (
    "column_name string, row_count bigint, missing_count bigint, zero_count bigint, minimum double, maximum double, "
    "distinct_sketch binary, rank_sketch binary, batch_id string")


def _value(column: str) -> Column:
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x), x + 0.0)


def batch_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The state of numeric columns, a row each, from one aggregate; missing is null and not-a-number."""
    parts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = _value(c)
        parts += [
            F.count(v).alias(f"k{i}"), F.count_if(v == 0).alias(f"z{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"),
            F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), DISTINCT_BITS).alias(f"d{i}"),
            F.kll_sketch_agg_double(v, RANK_K).alias(f"q{i}")]
    one = df.agg(*parts)
    return one.select(F.inline(F.array(*(
        F.struct(
            F.lit(c).alias("column_name"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"k{i}")).alias("missing_count"),
            F.col(f"z{i}").alias("zero_count"), F.col(f"a{i}").alias("minimum"), F.col(f"b{i}").alias("maximum"),
            F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("rank_sketch")) for i, c in enumerate(columns)))))


def store_state(state: DataFrame, path: str, batch_id: str) -> None:
    """Add the state of a batch to the history; the same batch again replaces it."""
    state.withColumn("batch_id", F.lit(batch_id)).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def merged(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per column, and group if given, from any number of states."""
    return states.groupBy(*by, "column_name").agg(
        *(F.sum(c).alias(c) for c in _COUNTS), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("rank_sketch").alias("rank_sketch"))


def report(states: DataFrame) -> DataFrame:
    """States in figures: counts, missing and zero shares, extremes, distinct values, quartiles; null where a column has no value."""
    known = F.col("row_count") > F.col("missing_count")
    quartiles = [
        F.when(known, F.kll_sketch_get_quantile_double("rank_sketch", F.lit(q))).alias(name)
        for q, name in zip(QUARTILES, ("lower_quartile", "median", "upper_quartile"))]
    others = [c for c in states.columns if not c.endswith("_sketch")]
    return states.select(
        *others, F.try_divide("missing_count", "row_count").alias("missing_share"), F.try_divide("zero_count", "row_count").alias("zero_share"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), *quartiles)


def span(states: DataFrame, first: str, last: str) -> DataFrame:
    """The report of all batches from one id to another, both included, merged; ids sort as text."""
    return report(merged(states.where(F.col("batch_id").between(first, last))))


def changes(states: DataFrame, missing_by: float = 0.05) -> DataFrame:
    """Per batch and column what moved since the batch before: shares, a median out of the earlier quartiles, a range left.

    ``flags`` lists missing, median, range and empty. The first batch of a column has none but
    empty. A window holds the batches of a column, a row each.
    """
    rows = report(states)
    before = W.partitionBy("column_name").orderBy("batch_id")
    names = ("missing_share", "minimum", "maximum", "lower_quartile", "upper_quartile")
    rows = rows.select("*", *(F.lag(c).over(before).alias(f"before_{c}") for c in names))
    flags = F.array_compact(F.array(
        F.when(F.abs(F.col("missing_share") - F.col("before_missing_share")) > missing_by, F.lit("missing")),
        F.when((F.col("median") < F.col("before_lower_quartile")) | (F.col("median") > F.col("before_upper_quartile")), F.lit("median")),
        F.when((F.col("minimum") < F.col("before_minimum")) | (F.col("maximum") > F.col("before_maximum")), F.lit("range")),
        F.when(F.col("row_count") == F.col("missing_count"), F.lit("empty"))))
    return rows.select(
        "batch_id", "column_name", "row_count", "missing_share", (F.col("missing_share") - F.col("before_missing_share")).alias("missing_change"),
        "median", flags.alias("flags"))
