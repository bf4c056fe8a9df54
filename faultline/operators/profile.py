"""Data-quality profile of a wide table from one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import schema as S
from faultline.functions import expressions as X
from faultline.operators.clean import feature_columns, is_class
from faultline.sources.tables import stage


@dataclass(frozen=True)
class ColumnProfile:
    ordinal: int
    column_name: str
    data_type: str
    row_count: int
    non_null: int
    missing_count: int
    single_valued: bool

    @property
    def missing_share(self) -> float:
        return self.missing_count / self.row_count if self.row_count else 0.0

    @property
    def constant_ignoring_null(self) -> bool:
        return self.non_null > 0 and self.single_valued

    @property
    def constant_counting_null(self) -> bool:
        return self.non_null == 0 or (self.non_null == self.row_count and self.single_valued)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, non-null and missing counts, single-valued flag.

    Every column adds a count, a minimum and a maximum to one global aggregate, so
    a partition sends one row. Distinct counts are not needed: a column has at most
    one value exactly when its minimum equals its maximum. Text goes in as its 64-bit
    hash; a text buffer would turn the hash aggregate into a sorting one.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, (c, dtype) in enumerate(df.dtypes):
        column = F.col(f"`{c}`")
        if dtype == "string":
            column = F.when(column.isNotNull(), F.xxhash64(column))
        aggregates += [
            F.count(column).alias(f"c{i}"),
            F.min(column).alias(f"lo{i}"),
            F.max(column).alias(f"hi{i}"),
        ]
    one = df.agg(*aggregates)
    entries = [
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            F.col("n").alias("row_count"),
            F.col(f"c{i}").alias("non_null"),
            (F.col("n") - F.col(f"c{i}")).alias("missing_count"),
            F.coalesce(F.col(f"lo{i}") == F.col(f"hi{i}"), F.lit(False)).alias("single_valued"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return one.select(F.inline(F.array(*entries)))


def collect_profile(df: DataFrame) -> list[ColumnProfile]:
    """The profile on the driver; as many rows as the schema has columns."""
    return [ColumnProfile(**r.asDict()) for r in column_profile(df).orderBy("ordinal").collect()]


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percent per column, most missing first."""
    profile = column_profile(df)
    share = F.try_divide(F.col("missing_count") * F.lit(100.0), F.col("row_count"))
    return profile.select("column_name", "missing_count", share.alias("missing_percentage"), "ordinal").orderBy(
        F.desc("missing_percentage"), "ordinal").drop("ordinal")


def top_missing(df: DataFrame, n: int = 20) -> DataFrame:
    return missing_profile(df).limit(n)


def missing_limits(df: DataFrame) -> DataFrame:
    """How many columns are missing in more than 50% and more than 90% of rows."""
    share = F.col("missing_percentage")
    return missing_profile(df).agg(
        F.count_if(share > 50).alias("above_50_percent"),
        F.count_if(share > 90).alias("above_90_percent"),
    )


def total_missing(df: DataFrame, features_only: bool = False) -> DataFrame:
    rows = column_profile(df.select(*(f"`{c}`" for c in feature_columns(df))) if features_only else df)
    return rows.agg(F.sum("missing_count").alias("total_missing"))


def profile_structure(df: DataFrame, n: int = 20) -> DataFrame:
    """Column count, row count and the first column names in one row.

    Only the row count needs the data; names come from the schema.
    """
    names = [F.lit(c) for c in df.columns[:n]]
    return df.agg(
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.count(F.lit(1)).alias("row_count"),
        F.concat_ws(",", *names).alias("first_columns"),
    )


def _constant(df: DataFrame, test) -> DataFrame:
    features = df.select(*(f"`{c}`" for c in df.columns if not is_class(c) and c != S.ROW_KEY))
    return column_profile(features).filter(test).orderBy("ordinal").select("column_name")


def constant_columns_ignore_null(df: DataFrame) -> DataFrame:
    """Features with one distinct non-null value; a wholly missing one is not reported."""
    return _constant(df, (F.col("non_null") > 0) & F.col("single_valued"))


def constant_columns_null_counts(df: DataFrame) -> DataFrame:
    """Features with at most one distinct value, null being a value."""
    full = F.col("non_null") == F.col("row_count")
    return _constant(df, (F.col("non_null") == 0) | (full & F.col("single_valued")))


def _profiles(df: DataFrame, profile) -> dict[str, ColumnProfile]:
    wanted = set(feature_columns(df))
    return {p.column_name: p for p in (profile or collect_profile(df)) if p.column_name in wanted}


def drop_constant(df: DataFrame, profile: Sequence[ColumnProfile] | None = None) -> DataFrame:
    dead = [n for n, p in _profiles(df, profile).items() if p.constant_counting_null]
    return df.drop(*dead)


def high_missing_columns(df: DataFrame, limit: float = S.MISSING_SHARE_LIMIT) -> DataFrame:
    """Features missing in more than the limit's share of rows, with that share in percent."""
    share = F.try_divide(F.col("missing_count").cast("double"), F.col("row_count").cast("double"))
    features = df.select(*(f"`{c}`" for c in feature_columns(df)))
    return (
        column_profile(features)
        .filter(share > limit)
        .orderBy("ordinal")
        .select("column_name", F.round(share * 100, 2).alias("missing_percentage"))
    )


def drop_high_missing(
    df: DataFrame,
    limit: float = S.MISSING_SHARE_LIMIT,
    profile: Sequence[ColumnProfile] | None = None,
) -> DataFrame:
    """Strictly above the limit: a feature missing in exactly half the rows stays."""
    dead = [n for n, p in _profiles(df, profile).items() if p.missing_share > limit]
    return df.drop(*dead)


def target_profile(df: DataFrame, column: str = S.CLASS) -> DataFrame:
    """Rows and percent (4 decimals) per class; missing classes count in the total only."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("class_count"))
    whole = F.sum("class_count").over(W.partitionBy())
    shares = counts.withColumn("percentage", X.percent(F.col("class_count"), whole, 4))
    return shares.filter(F.col(column).isNotNull()).orderBy(F.desc("class_count"), column)


def class_balance(df: DataFrame, label: str = "label", split: str | None = None) -> DataFrame:
    keys = [split, label] if split else [label]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).orderBy(*keys)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row, nulls being equal.

    Rows are compared by 128 bits of hash, so the shuffle carries two numbers per
    distinct row and not the whole width; copies are merged before it, which keeps
    one much-repeated row from filling a task.
    """
    first, second = X.row_hashes(df.columns)
    copies = df.groupBy(first.alias("first"), second.alias("second")).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("rows_analyzed"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def _entry(metric: str, key, value):
    return F.struct(
        F.lit(metric).alias("metric"), F.lit(key).cast("string").alias("key"), value.cast("double").alias("value"))


def _class_entries(df: DataFrame, column: str):
    keys = F.coalesce(F.col(column).cast("string"), F.lit("(missing)"))
    return df.groupBy(keys.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, columns per type and class counts as (metric, key, value)."""
    per_type: dict[str, int] = {}
    for _, dtype in df.dtypes:
        per_type[dtype] = per_type.get(dtype, 0) + 1
    profile = column_profile(df)
    totals = profile.agg(
        F.max("row_count").alias("rows"), F.sum("missing_count").alias("missing"))
    entries = [
        _entry("rows", None, F.col("rows")),
        _entry("columns", None, F.lit(len(df.columns))),
        _entry("total_missing", None, F.col("missing")),
        *(_entry("dtype", t, F.lit(k)) for t, k in sorted(per_type.items())),
    ]
    head = totals.select(F.inline(F.array(*entries)))
    name = next((c for c in df.columns if is_class(c)), None)
    if name is None:
        return head
    classes = _class_entries(df, name).select(
        F.lit("class_count").alias("metric"), "key", F.col("n").cast("double").alias("value"))
    return head.unionByName(classes)


def first_rows(df: DataFrame, n: int = 5, order: str = S.ROW_KEY) -> DataFrame:
    """The head of a summary: the n rows that come first in the given order."""
    return df.orderBy(order).limit(n)


def preprocess_summary(df: DataFrame, column: str = S.CLASS) -> DataFrame:
    """The closing report: rows, columns, features, missing feature cells, class counts and percents.

    Rows and missing cells are counted per class in one grouped pass, of which everything
    else is a sum.
    """
    features = feature_columns(df)
    gaps = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in features), F.lit(0))
    classes = stage(df.groupBy(F.col(column).cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), gaps.cast("bigint").alias("missing")), "class-profile")
    totals = classes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    head = totals.select(F.inline(F.array(
        _entry("rows", None, F.col("rows")), _entry("columns", None, F.lit(len(features) + 1)),
        _entry("features", None, F.lit(len(features))), _entry("total_missing", None, F.col("missing")))))
    whole = F.sum("n").over(W.partitionBy())
    known = classes.withColumn("rows", whole).where(F.col("key").isNotNull())
    per_class = known.select(F.inline(F.array(
        F.struct(F.lit("class_count").alias("metric"), "key", F.col("n").cast("double").alias("value")),
        F.struct(F.lit("class_percent").alias("metric"), "key", X.percent(F.col("n"), F.col("rows"), 4).alias("value")))))
    return head.unionByName(per_class)


def assert_raw(df: DataFrame, rows: int, columns: int, column: str = S.CLASS) -> DataFrame:
    """The contract of a raw sensor set as (check, passed, observed) rows."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    target = F.col(column)
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(target == S.NEGATIVE).alias("neg"),
        F.count_if(target == S.POSITIVE).alias("pos"),
        F.count_if(target.isNotNull() & ~target.isin(S.NEGATIVE, S.POSITIVE)).alias("others"),
    )
    both = (F.col("neg") > 0) & (F.col("pos") > 0) & (F.col("others") == 0)
    width = F.lit(len(df.columns))
    return one.select(F.inline(F.array(
        _check("row_count", F.col("rows") == rows, F.col("rows")),
        _check("column_count", width == columns, width),
        _check("classes", both, F.col("others")),
    )))


def _check(name: str, passed, observed):
    return F.struct(
        F.lit(name).alias("check"), passed.alias("passed"), observed.cast("bigint").alias("observed"))


def assert_processed(df: DataFrame, rows: int, features: int, column: str = S.CLASS) -> DataFrame:
    """Post-conditions of preprocessing as (check, passed, observed) rows.

    The missing cells and the target values come from one aggregate.
    """
    names = feature_columns(df)
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in names), F.lit(0))
    target = F.col(column)
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        missing.cast("bigint").alias("missing"),
        F.count_if(target == 0).alias("zeros"),
        F.count_if(target == 1).alias("ones"),
        F.count_if(~F.coalesce(target.isin(0, 1), F.lit(False))).alias("others"),
    )

    binary = (F.col("zeros") > 0) & (F.col("ones") > 0) & (F.col("others") == 0)
    width = F.lit(len(names))
    return one.select(F.inline(F.array(
        _check("no_missing", F.col("missing") == 0, F.col("missing")),
        _check("target_is_binary", binary, F.col("others")),
        _check("row_count", F.col("rows") == rows, F.col("rows")),
        _check("feature_count", width == features, width),
    )))
