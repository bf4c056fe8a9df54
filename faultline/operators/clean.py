"""Column names, missing tokens, numeric coercion, fills and row filters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline import schema as S
from faultline.functions import expressions as X


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"column names collide: {seen[name.lower()]!r} and {name!r}")
        seen[name.lower()] = name
    return names


def is_class(name: str) -> bool:
    return name.lower() == S.CLASS


def feature_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    """Every column but the class, the row key and those to skip, in schema order."""
    other = {S.CLASS, S.ROW_KEY, *(s.lower() for s in skip)}
    return [c for c in df.columns if c.lower() not in other]


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*_unique([re.sub(r"^\s+|\s+$", "", c) for c in df.columns]))


def upper_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*_unique([c.upper() for c in df.columns]))


def _map_features(df: DataFrame, change, skip: Iterable[str] = ()) -> DataFrame:
    """One projection over all features: a chain of 170 ``withColumn`` would not plan."""
    features = set(feature_columns(df, skip))
    return df.select(*(
        change(c).alias(c) if c in features else _quoted(c) for c in df.columns
    ))


def nullify_tokens(df: DataFrame, tokens: Sequence[str] = S.INGEST_NA_TOKENS) -> DataFrame:
    """Missing tokens to null in every text column, the class included."""
    text = {f.name for f in df.schema if f.dataType.typeName() == "string" and f.name != S.ROW_KEY}
    return df.select(*(
        X.na_to_null(_quoted(c), tokens).alias(c) if c in text else _quoted(c) for c in df.columns
    ))


def to_numeric(df: DataFrame) -> DataFrame:
    """Every feature to double, unparsable cells to null.

    The number pattern rejects every missing token, so no separate token pass is
    needed here.
    """
    types = dict(df.dtypes)

    def change(c: str) -> Column:
        if types[c] == "string":
            return X.to_double(_quoted(c))
        return X.not_nan(_quoted(c))

    return _map_features(df, change)


def clean_numeric_strict(df: DataFrame, scale: int | None = 0) -> DataFrame:
    """The warehouse's typed copy: only trimmed ``na`` is a token, column order is kept."""
    return _map_features(df, lambda c: X.to_number(_quoted(c), scale))


def exclude_columns(df: DataFrame, names: Sequence[str] = S.EXCLUDED_FEATURES) -> DataFrame:
    known = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in known]
    if missing:
        raise ValueError(f"columns to exclude are absent: {missing}")
    return df.drop(*names)


def select_top_features(df: DataFrame, features: Sequence[str] = S.TOP_FEATURES, keep: Sequence[str] = (S.CLASS,)) -> DataFrame:
    """Class and the named features, in the order of the list."""
    return df.select(*(F.col(c).alias(c.lower()) for c in (*keep, *features)))


def zero_impute(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(features or feature_columns(df)))


def count_missing(df: DataFrame, features: Sequence[str] | None = None, name: str = "total_missing") -> DataFrame:
    """Missing cells over the given columns, as one row of one aggregate."""
    columns = list(features if features is not None else df.columns)
    per_row = sum((F.when(_quoted(c).isNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row.cast("bigint")), F.lit(0)).cast("bigint").alias(name))


def encode_target(df: DataFrame, column: str = S.CLASS, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, X.encode_target(column))


def drop_incomplete_rows(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    return df.dropna(how="any", subset=[*features, label])


def filter_class(df: DataFrame, value: str, column: str = S.CLASS) -> DataFrame:
    return df.filter(F.col(column) == value)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def column_listagg(rows: DataFrame, text: str, order: str, separator: str = ", ", name: str = "column_list") -> DataFrame:
    """One string built from a frame with one row per column, in the given order.

    ``text`` and ``order`` are SQL expressions. The input is as long as a schema is
    wide; do not pass row-level data.
    """
    mark = separator.replace("'", "''")
    return rows.agg(F.expr(f"listagg({text}, '{mark}') WITHIN GROUP (ORDER BY {order})").alias(name))


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Name every missing feature at once, then return the features in model order.

    Names match in any case, row key and class take their own names; a missing cell or text
    becomes null for the caller's fill.
    """
    have = {c.upper(): c for c in df.columns}
    missing = [f for f in features if f.upper() not in have]
    if missing:
        raise ValueError("model features missing from the input: " + ", ".join(missing))
    types = dict(df.dtypes)
    keep = [_quoted(c).alias(c.lower()) for c in df.columns if c.lower() in (S.ROW_KEY, S.CLASS)]
    columns = []
    for f in features:
        source = have[f.upper()]
        number = X.to_double(_quoted(source)) if types[source] == "string" else X.not_nan(_quoted(source))
        columns.append(number.alias(f))
    return df.select(*keep, *columns)
