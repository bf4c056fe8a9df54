"""Intervals for model measures and for differences of models, by a Poisson bootstrap.

In a replicate each row weighs Poisson(1). Rows with the same label and the same scores are
alike, and n of them together weigh Poisson(n); so rows are merged by their scores first, and a
replicate draws one weight per merged cell and label. The draw is a function of the cell's
scores, the label and the replicate: results do not depend on partitioning, and all models see
the same replicate of the rows, so differences are paired.

Per model the cells are dealt out in ranges of its score. One pass over the ranges gives the
weight of each class per range and replicate, running sums of those are what lies beyond a
range, and a second pass adds up the areas. All replicates share both passes; what is held in a
task is a range of cells and ``AT_ONCE`` replicates of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import schema as S
from faultline.sources.tables import stage

REPLICATES = 200
RANGE_CELLS = 50_000
AT_ONCE = 20
_EXACT = 64
_TOTALS = "place int, replicate int, positives double, negatives double"
_AREAS = "replicate int, roc double, precision double"


def _tables() -> np.ndarray:
    """Distribution functions of Poisson(n) for n up to ``_EXACT``."""
    k = np.arange(200)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 200)))))
    n = np.arange(1, _EXACT + 1)[:, None]
    return np.vstack((np.ones(200), np.cumsum(np.exp(k * np.log(n) - n - logs), axis=1)))


_CDF = _tables()


def _uniform(cells: np.ndarray, replicate: int, label: int, part: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1) by cell, replicate, label and part of the draw."""
    salt = hashlib.blake2b(f"{seed},{replicate},{label},{part}".encode(), digest_size=8).digest()
    x = cells ^ np.frombuffer(salt, np.uint64)[0]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def drawn(cells: np.ndarray, counts: np.ndarray, replicate: int, label: int, seed: int) -> np.ndarray:
    """Weights of merged rows: Poisson(count) each; by inversion for small counts, else by a normal with its skew."""
    out = np.zeros(len(counts))
    small = (counts > 0) & (counts <= _EXACT)
    if replicate < 0:
        return counts.astype(float)
    u = _uniform(cells, replicate, label, 0, seed)
    for n in np.unique(counts[small]).tolist():
        at = counts == n
        out[at] = np.searchsorted(_CDF[n], u[at], side="left")
    large = counts > _EXACT
    if large.any():
        z = np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * _uniform(cells[large], replicate, label, 1, seed))
        out[large] = np.maximum(0, np.rint(counts[large] + np.sqrt(counts[large]) * z + (z * z - 1) / 6))
    return out


def merged_cells(df: DataFrame, scores: Sequence[str], label: str = "label") -> DataFrame:
    """Rows merged by all scores: cell (a hash of them), s0, s1 ..., positives, negatives.

    Rows without a label of 0 or 1, or with a score that is null or not a number, are left out.
    """
    values = [F.col(f"`{s}`").cast("double") for s in scores]
    usable = F.col(label).isin(0, 1)
    for v in values:
        usable = usable & v.isNotNull() & ~F.isnan(v)
    # Adding 0 makes one zero of both.
    rows = df.where(usable).select(*((v + 0.0).alias(f"s{i}") for i, v in enumerate(values)), F.col(label).alias("y"))
    names = [f"s{i}" for i in range(len(values))]
    return rows.groupBy(*names).agg(F.count_if(F.col("y") == 1).alias("positives"), F.count_if(F.col("y") == 0).alias("negatives")).select(
        F.xxhash64(*names).alias("cell"), *names, "positives", "negatives")


def _dealt(cells: DataFrame, score: str) -> DataFrame:
    """Cells in ranges of one score, highest first; equal scores are in one range."""
    count = cells.count()
    parts = max(1, -(-count // RANGE_CELLS))
    rows = cells.select("cell", F.col(score).alias("score"), "positives", "negatives").repartitionByRange(parts, F.desc("score"))
    return stage(rows.withColumn("place", F.spark_partition_id()), "benchmark-ranges")


def _weights(frame: pd.DataFrame, replicates: range, seed: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Weights of both classes by distinct score (highest first) and replicate, some replicates at a time."""
    frame = frame.sort_values(["score", "cell"], ascending=False)
    score, cell = frame["score"].to_numpy(), frame["cell"].to_numpy().view(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
    for start in range(replicates.start, replicates.stop, AT_ONCE):
        some = range(start, min(start + AT_ONCE, replicates.stop))
        sides = [
            np.stack([np.add.reduceat(drawn(cell, frame[name].to_numpy(), b, label, seed), first) for b in some], axis=1)
            for label, name in ((1, "positives"), (0, "negatives"))]
        yield some, sides[0], sides[1]


def replicates(cells: DataFrame, score: str, count: int = REPLICATES, seed: int = S.SEED) -> DataFrame:
    """Per replicate (-1: the rows as they are) both areas of one score of merged cells: replicate, roc_auc, average_precision.

    Null where a replicate has no row of a class.
    """
    wanted = range(-1, count)
    rows = _dealt(cells, score)

    def totals(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [
            pd.DataFrame({"place": frame["place"].iat[0], "replicate": list(some), "positives": p.sum(axis=0), "negatives": n.sum(axis=0)})
            for some, p, n in _weights(frame, wanted, seed)]
        return pd.concat(parts)

    sums = stage(rows.groupBy("place").applyInPandas(totals, _TOTALS), "benchmark-totals")
    above = W.partitionBy("replicate").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("place", "replicate", *(F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("positives", "negatives")))

    def areas(frame: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame({"replicate": [], "roc": [], "precision": []})
        before = before.set_index("replicate").sort_index()
        out = []
        for some, p, n in _weights(frame, wanted, seed):
            start = before.loc[list(some)]
            hits = np.cumsum(p, axis=0) + start["positives"].to_numpy()
            wrong = np.cumsum(n, axis=0) + start["negatives"].to_numpy()
            roc = (n * (hits - p / 2)).sum(axis=0)
            precision = (p * np.divide(hits, hits + wrong, out=np.zeros_like(hits), where=hits + wrong > 0)).sum(axis=0)
            out.append(pd.DataFrame({"replicate": list(some), "roc": roc, "precision": precision}))
        return pd.concat(out)

    parts = rows.groupBy("place").cogroup(carried.groupBy("place")).applyInPandas(areas, _AREAS)
    whole = sums.groupBy("replicate").agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    return parts.groupBy("replicate").agg(F.sum("roc").alias("roc"), F.sum("precision").alias("precision")).join(whole, "replicate").select(
        "replicate", F.try_divide("roc", F.col("p") * F.col("n")).alias("roc_auc"), F.try_divide("precision", "p").alias("average_precision"))


def benchmark(
    df: DataFrame, models: Sequence[str], baseline: str | None = None, label: str = "label", count: int = REPLICATES,
    share: float = 0.95, seed: int = S.SEED,
) -> DataFrame:
    """Per model (a score column), measure and kind: estimate, mean, deviation, low and high.

    Kind ``value`` is the measure; ``difference`` is that of the model less the baseline's (the
    first model unless named), replicate by replicate. Low and high hold ``share`` of the replicates that
    have both classes, their number is ``replicates``.
    """
    models = list(models)
    baseline = baseline or models[0]
    cells = stage(merged_cells(df, models, label), "benchmark-cells")
    measures = ("roc_auc", "average_precision")
    runs = {m: stage(replicates(cells, f"s{i}", count, seed), "benchmark-replicates") for i, m in enumerate(models)}
    base = runs[baseline].select(F.col("replicate").alias("r"), *(F.col(c).alias(f"base_{c}") for c in measures))
    long = None
    for m in models:
        both = runs[m].join(base, F.col("replicate") == F.col("r"))
        entries = [F.struct(F.lit(c).alias("measure"), F.lit("value").alias("kind"), F.col(c).alias("v")) for c in measures]
        if m != baseline:
            entries += [F.struct(F.lit(c).alias("measure"), F.lit("difference").alias("kind"), (F.col(c) - F.col(f"base_{c}")).alias("v")) for c in measures]
        part = both.select(F.lit(m).alias("model"), "replicate", F.inline(F.array(*entries)))
        long = part if long is None else long.unionByName(part)
    drawn_ = F.when(F.col("replicate") >= 0, F.col("v"))
    return long.groupBy("model", "measure", "kind").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("v"))).alias("estimate"), F.avg(drawn_).alias("mean"), F.stddev(drawn_).alias("deviation"),
        F.percentile(drawn_, (1 - share) / 2).alias("low"), F.percentile(drawn_, (1 + share) / 2).alias("high"),
        F.count(drawn_).alias("replicates"))
