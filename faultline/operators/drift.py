"""Drift of many features against a stored reference.

The reference is fitted once: bucket edges per feature from one aggregate of mergeable quantile
sketches, and the rows of each bucket. It is a small table, stored and read again. A later
batch is read once, whatever the number of features: each task counts its rows by (feature,
bucket), the counts merge before the shuffle, and everything else happens on a row per bucket.

Two measures per feature:

- ``psi``, the population stability index over all buckets, missing cells being one of them;
  half a row is added to each bucket, so an empty one stays finite.
- ``max_distance``, the largest distance of the two distribution functions at the edges, over
  the rows that are not missing. Between edges it may be larger by at most the reference's
  share of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from faultline.sources.tables import write_small

BUCKETS = 20
ACCURACY = 10_000
#: Index values from which a feature is called moderate or shifted.
MODERATE, SHIFTED = 0.1, 0.25
MISSING = -1

#: feature, its place, bucket (-1: missing), the bucket's upper edge (null: the last, or missing), rows.
Reference = DataFrame


@dataclass(frozen=True)
class Edges:
    """Upper edges of the buckets of each feature, the last bucket's left out."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]


def fit_edges(df: DataFrame, features: Sequence[str], buckets: int = BUCKETS, accuracy: int = ACCURACY) -> Edges:
    """Edges at equal ranks of the values that are not missing; a constant or empty feature has none."""
    shares = [i / buckets for i in range(1, buckets)]
    parts = []
    for i, f in enumerate(features):
        x = _value(f)
        parts += [F.percentile_approx(x, shares, accuracy).alias(f"q{i}"), F.max(x).alias(f"m{i}")]
    row = df.agg(*parts).first()
    return Edges(tuple(features), tuple(
        tuple(sorted({float(v) for v in row[f"q{i}"] or () if v < row[f"m{i}"]})) for i in range(len(features))))


def _value(feature: str) -> Column:
    x = F.col(f"`{feature}`").cast("double")
    return F.when(~F.isnan(x), x)


def bucket_counts(df: DataFrame, edges: Edges) -> DataFrame:
    """Rows by (place, bucket) of all features in one pass; bucket -1 holds null and not-a-number."""
    width = max((len(e) for e in edges.edges), default=0) + 2
    known = [np.array(e, float) for e in edges.edges]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(known), width), np.int64)
        for batch in batches:
            for place, cuts in enumerate(known):
                x = batch.column(place).to_numpy(zero_copy_only=False).astype(float)
                bucket = np.where(np.isnan(x), MISSING, np.searchsorted(cuts, x, side="left"))
                seen[place] += np.bincount(bucket + 1, minlength=width)
        place, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(bucket - 1, pa.int32()), pa.array(seen[place, bucket], pa.int64())],
            names=["place", "bucket", "n"])

    rows = df.select(*(F.col(f"`{f}`").cast("double").alias(f"c{i}") for i, f in enumerate(edges.features)))
    return rows.mapInArrow(count, "place int, bucket int, n bigint").groupBy("place", "bucket").agg(F.sum("n").alias("n"))


def fit_reference(df: DataFrame, features: Sequence[str], buckets: int = BUCKETS, accuracy: int = ACCURACY) -> Reference:
    """The reference table: a row per feature and bucket, empty ones included."""
    edges = fit_edges(df, features, buckets, accuracy)
    frame = [
        (place, f, bucket, own[bucket] if 0 <= bucket < len(own) else None)
        for place, (f, own) in enumerate(zip(edges.features, edges.edges)) for bucket in range(MISSING, len(own) + 1)]
    grid = df.sparkSession.createDataFrame(frame, "place int, feature string, bucket int, edge double")
    return grid.join(bucket_counts(df, edges), ["place", "bucket"], "left").select(
        "place", "feature", "bucket", "edge", F.coalesce("n", F.lit(0)).alias("reference_rows"))


def save_reference(reference: Reference, path: str) -> None:
    write_small(reference, path, "parquet")


def load_reference(spark: SparkSession, path: str) -> Reference:
    return spark.read.parquet(path)


def edges_of(reference: Reference) -> Edges:
    """The edges again from the stored table (a row per feature and bucket)."""
    rows = reference.orderBy("place", "bucket").collect()
    features = {r["place"]: r["feature"] for r in rows}
    return Edges(tuple(features[p] for p in sorted(features)), tuple(
        tuple(r["edge"] for r in rows if r["place"] == p and r["edge"] is not None) for p in sorted(features)))


def drift(reference: Reference, current: DataFrame) -> DataFrame:
    """Per feature: feature, psi, max_distance, rows and missing rows on both sides, level.

    ``level`` is stable, moderate or shifted by the index. A side without rows gives nulls and
    the level ``unknown``; a side whose cells are all missing has no distance.
    """
    counts = bucket_counts(current, edges_of(reference))
    both = reference.join(counts, ["place", "bucket"], "left").select(
        "place", "feature", "bucket", F.col("reference_rows").alias("a"), F.coalesce("n", F.lit(0)).alias("b"))
    feature, upto = W.partitionBy("place"), W.partitionBy("place").orderBy("bucket")
    present = [F.when(F.col("bucket") != MISSING, F.col(c)).otherwise(0) for c in "ab"]
    spread = both.select(
        "*", F.count(F.lit(1)).over(feature).alias("k"), *(F.sum(c).over(feature).alias(f"{c}_all") for c in "ab"),
        *(F.sum(x).over(feature).alias(f"{c}_present") for c, x in zip("ab", present)),
        *(F.sum(x).over(upto).alias(f"{c}_upto") for c, x in zip("ab", present)))
    shares = [(F.col(c) + 0.5) / (F.col(f"{c}_all") + 0.5 * F.col("k")) for c in "ab"]
    distance = F.abs(F.try_divide("a_upto", "a_present") - F.try_divide("b_upto", "b_present"))
    rows = spread.groupBy("place", "feature").agg(
        F.sum((shares[1] - shares[0]) * F.log(shares[1] / shares[0])).alias("psi"),
        F.max(distance).alias("max_distance"),
        F.max("a_all").alias("reference_rows"), F.max("b_all").alias("current_rows"),
        (F.max("a_all") - F.max("a_present")).alias("reference_missing"), (F.max("b_all") - F.max("b_present")).alias("current_missing"))
    known = (F.col("reference_rows") > 0) & (F.col("current_rows") > 0)
    return rows.select(
        "feature", F.when(known, F.col("psi")).alias("psi"), "max_distance", "reference_rows", "current_rows",
        "reference_missing", "current_missing",
        F.when(~known, "unknown").when(F.col("psi") >= SHIFTED, "shifted").when(F.col("psi") >= MODERATE, "moderate")
        .otherwise("stable").alias("level"))
