"""Connected components of an edge table, by built-in functions only.

Large-star and small-star steps in turn: every vertex hands its larger neighbours to the
smallest one it knows, then itself and its smaller neighbours. The edge count never grows
beyond the input and the number of rounds grows with the logarithm of the longest path.

A vertex with very many neighbours is no group of one task: its smallest neighbour is found
by an aggregate that merges before the shuffle, is written, and meets the edges again in a
plain join, which adaptive execution splits where one key is hot. Each round is written to
the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.session import remove_path, scratch_path
from faultline.sources.tables import write_stage


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    return write_stage(df, path), path


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """One step over edges (a, b); ``large`` looks at all neighbours, else at the smaller ones."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near, near_path = _staged(near, "star-near")
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least, least_path = _staged(least.select("a", F.least("a", "m").alias("m")), "star-least")
    linked = near.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct(), [near_path, least_path]


def components(edges: DataFrame, left: str, right: str, vertex: str = "vertex", component: str = "component") -> DataFrame:
    """Each vertex of an edge with the smallest vertex that it reaches.

    Null ends and loops are ignored, repeated and reversed edges count once, an empty table
    gives an empty one. Vertices are of any ordered type, the same on both sides.
    """
    spark = edges.sparkSession
    current, path = _staged(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct(), "edges")
    total = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while total[0]:
        before = total
        for large in (True, False):
            following, used = _star(current, large)
            following, following_path = _staged(following, "edges")
            for old in (*used, path):
                remove_path(spark, old)
            current, path = following, following_path
        total = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == before:
            break
    roots = current.select(F.col("b").alias(vertex)).distinct()
    return current.select(F.col("a").alias(vertex), F.col("b").alias(component)).unionByName(
        roots.select(vertex, F.col(vertex).alias(component)))
