"""Similarity join over hash tables, in bounded blocks.

Rows are first collapsed to classes of equal content. Each class has a sketch, a payload
and a key per hash table; classes with a key in common are candidates.

- A key with many classes is cut into blocks of about ``BLOCK_ROWS``; each pair of blocks is
  a group of its own, so no group exceeds two blocks and nothing is dropped.
- Round one moves keys and sketches only and keeps the classes for which some candidate
  passes the screen. Round two moves the payloads of those and verifies exactly.
- A pair that meets in several tables counts in the first one only, which both sides can
  tell from their sketches. So pairs are counted where they meet and never written: a
  group returns one row per class (its links there, and a root of its connected part).

Groups are sorted runs of a hash partitioning, read through ``mapInPandas``; a run that
crosses an Arrow batch is carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.components import components
from faultline.session import remove_path, scratch_path
from faultline.sources.tables import stage, write_stage

BLOCK_ROWS = 512

GROUP = ("key", "lo", "hi")
Pairs = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Method:
    """How sketches are screened and payloads compared; both work on index pairs of two sides.

    screen(left, right, i, j, table) gets sketches as rows of bytes and keeps the pairs that
    may be links and meet in no earlier table. verify(left, right, i, j) gets lists of
    payloads and says which pairs are links.
    """

    screen: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], Pairs]
    verify: Callable[[list[bytes], list[bytes], np.ndarray, np.ndarray], np.ndarray]


def sorted_runs(batches: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Frames of rows with equal keys, from batches that are sorted by them."""
    rest: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if rest and first != last:
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if a and rest:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(batch.iloc[a:b])
        last = tuple(c[-1] for c in columns)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _sides(run: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of both sides in the run, and all pairs of them as indices of the sides."""
    lo, hi = run["lo"].iat[0], run["hi"].iat[0]
    size = len(run)
    if lo == hi:
        everyone = np.arange(size)
        i, j = np.triu_indices(size, 1)
        return everyone, everyone, i, j
    mine = run["mine"].to_numpy()
    left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    i, j = np.indices((len(left), len(right))).reshape(2, -1)
    return left, right, i, j


def _sketches(run: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(run["sketch"]), np.uint8).reshape(len(run), -1)


def candidates(keys: DataFrame) -> DataFrame:
    """Of (cid, table, key) the rows whose key others share, by block pair: cid, table, key, lo, hi, mine."""
    shared = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "join-keys")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    rows = keys.join(shared, "key").withColumn("blocks", blocks).select(
        "cid", "table", "key", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("mine"), "blocks")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "cid", "table", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")


def _dealt(rows: DataFrame, like: DataFrame) -> DataFrame:
    parts = int(like.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *GROUP).sortWithinPartitions(*GROUP)


def screened(rows: DataFrame, method: Method) -> DataFrame:
    """The candidate rows (with sketch) that pass the screen with some partner of their group."""
    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, waiting = [], 0
        for run in sorted_runs(batches, GROUP):
            left, right, i, j = _sides(run)
            if not len(i):
                continue
            sketches = _sketches(run)
            i, j = method.screen(sketches[left], sketches[right], i, j, int(run["table"].iat[0]))
            if len(i):
                out.append(run.iloc[np.unique(np.concatenate((left[i], right[j])))].drop(columns="sketch"))
                waiting += len(out[-1])
            if waiting > 5_000:
                yield pd.concat(out)
                out, waiting = [], 0
        if out:
            yield pd.concat(out)

    return _dealt(rows, rows).mapInPandas(passed, "cid bigint, table int, key bigint, lo int, hi int, mine int")


def _roots(size: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """The smallest position that each position is joined to by the pairs."""
    parent = list(range(size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(size)]


def verified(rows: DataFrame, method: Method) -> DataFrame:
    """Of rows with sketch, payload and copies: per group and class its links and a root (cid, links, root)."""
    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in sorted_runs(batches, GROUP):
            run = run.drop_duplicates("cid")
            left, right, i, j = _sides(run)
            if not len(i):
                continue
            sketches = _sketches(run)
            i, j = method.screen(sketches[left], sketches[right], i, j, int(run["table"].iat[0]))
            if not len(i):
                continue
            payloads = run["payload"].tolist()
            good = method.verify([payloads[x] for x in left], [payloads[x] for x in right], i, j)
            a, b = left[i[good]], right[j[good]]
            if not len(a):
                continue
            cid, copies = run["cid"].to_numpy(), run["copies"].to_numpy()
            links = np.zeros(len(run), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            roots = cid[_roots(len(run), a, b)]
            met = links > 0
            yield pd.DataFrame({"cid": cid[met], "links": links[met], "root": roots[met]})

    return _dealt(rows, rows).mapInPandas(linked, "cid bigint, links bigint, root bigint")


def linked_classes(classes: DataFrame, keys: DataFrame, payloads: Callable[[DataFrame], DataFrame], method: Method) -> DataFrame:
    """Per class with links: cid, links (copies of other classes), component (smallest cid).

    ``classes`` has cid, copies and sketch, ``keys`` has cid, table and key. ``payloads`` gets
    rows with cid and adds payload to each; it may repeat a row, and drop those that the
    method need not see.
    """
    spark = classes.sparkSession
    found = candidates(keys).join(classes.select("cid", "sketch"), "cid")
    path = scratch_path(spark, "join-screened")
    survivors = write_stage(screened(found, method), path)
    dressed = payloads(survivors).join(classes.select("cid", "copies", "sketch"), "cid")
    links = stage(verified(dressed, method), "join-links")
    remove_path(spark, path)
    groups = components(links, "cid", "root", "cid", "component")
    totals = links.groupBy("cid").agg(F.sum("links").alias("links"))
    return stage(totals.join(groups, "cid", "left").withColumn(
        "component", F.coalesce("component", "cid")), "join-classes")


def with_links(rows: DataFrame, classes: DataFrame, linked: DataFrame, key: Column) -> DataFrame:
    """Rows (with content) and their class's figures: rep, links, component_rep.

    ``classes`` has content, cid, copies and rep (its smallest row id); ``linked`` is the
    result of ``linked_classes``. Rows without content get no links and themselves.
    """
    figures = classes.join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    figures = stage(figures.select("content", "cid", "copies", "rep", "component", F.coalesce("links", F.lit(0)).alias("links")), "join-figures")
    least = figures.groupBy("component").agg(F.min("rep").alias("component_rep"))
    figures = stage(figures.join(least, "component"), "join-classes")
    found = rows.join(figures.select("content", "copies", "rep", "links", "component_rep", "cid", "component"), "content", "left")
    return (
        found.withColumn("n_links", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint"))
        .withColumn("rep", F.coalesce("rep", key)).withColumn("component_rep", F.coalesce("component_rep", key))
        .drop("links", "copies"))
