"""Second-order boosted trees for 0/1 labels, grown from histograms.

Per round the loss is replaced by its gradient and hessian at each row; a tree is the one
that gains most on their sums, with a penalty per leaf (``gamma``), on the size of leaf
values (``alpha``, ``lambda_``) and a least hessian per child (``child_weight``). Rows and
features are drawn per tree.

- Features become bins once, by cuts from one pass of mergeable summaries. The binned rows
  are written in blocks with their margin: a byte per cell.
- The trees are grown by tasks that keep their blocks for all rounds (``growing.py``).

Rows are drawn by a hash of the row and the round, so the model does not depend on how the
rows are dealt over tasks, but for the rounding of sums and, beyond as many distinct values as
a summary holds, for cuts that differ by a fraction of a bin from run to run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline import schema as S
from faultline.operators import growing
from faultline.operators.growing import Grown, Objective, Tree
from faultline.session import remove_path, scratch_path
from faultline.sources.tables import write_small, write_stage

#: Rounds after which the trees are stored for a stage that has to run again.
REWRITE = 10
#: Rows of a task: at least as many, unless there are fewer.
TASK_ROWS = 50_000
#: Blocks that meet a worker at once.
BATCH_BLOCKS = 8
#: Values that a summary of a feature holds per bin, and at least.
RANK_K, LEAST_K = 16, 1024
#: Rows that are summed up at once.
SUMMARY_ROWS = 200_000
_BLOCK = "bins binary, label binary, weight binary, row binary, margin binary"
#: Splits that gain no more than this are rounding.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Params:
    """Settings of a booster; the defaults are those of the reference's plain model."""

    rounds: int = 300
    depth: int = 5
    step: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    child_weight: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lambda_: float = 1.0
    bins: int = 256
    base: float = 0.0
    seed: int = S.SEED

    def leaf(self, g, h):
        """The value that is best for a node, before the step; 0 for a node that nothing weighs on."""
        return -self._over(self._shrunk(g), h)

    def quality(self, g, h):
        """What a node gains over a value of zero."""
        return self._over(self._shrunk(g) ** 2, h)

    def _over(self, x, h):
        below = np.asarray(h + self.lambda_)
        return np.divide(x, below, out=np.zeros(below.shape), where=below > 0)

    def _shrunk(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0.0)


#: Settings of the reference's model for rare failures; positives weigh as much as negatives.
WEIGHTED = Params(child_weight=3.0, gamma=0.1, alpha=0.1, lambda_=1.0)


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: its feature order, the margin it starts from, its trees, and the loss before each round."""

    features: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...]
    losses: tuple[float, ...] = ()

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log-odds of rows (features x rows)."""
        if np.isnan(values).any():
            raise ValueError("a feature is missing; fill missing cells before scoring")
        out = np.full(values.shape[1], self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.ends(values, False)]
        return out

    def probability(self) -> Column:
        """The probability of failure as a column over the features."""
        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            margin = self.margins(np.stack([c.to_numpy(float) for c in columns]))
            return pd.Series(1 / (1 + np.exp(-margin)))

        return scored(*(F.col(f"`{f}`").cast("double") for f in self.features))

    def save(self, spark: SparkSession, path: str) -> None:
        """Two small tables: the nodes, and the features in their order with the base."""
        nodes = [
            (t, n, *(column[n] for column in (tree.feature, tree.bin, tree.cut, tree.left, tree.right, tree.value, tree.cover)))
            for t, tree in enumerate(self.trees) for n in range(len(tree.feature))]
        write_small(spark.createDataFrame(
            nodes, "tree int, node int, feature int, bin int, cut double, left int, right int, value double, cover double"), f"{path}/nodes", "parquet")
        write_small(spark.createDataFrame(
            [(i, f, self.base) for i, f in enumerate(self.features)], "position int, name string, base double"), f"{path}/features", "parquet")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        features = sorted(tuple(r) for r in spark.read.parquet(f"{path}/features").collect())
        trees: dict[int, Tree] = {}
        for r in sorted(tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()):
            tree = trees.setdefault(r[0], Tree())
            for column, x in zip((tree.feature, tree.bin, tree.cut, tree.left, tree.right, tree.value, tree.cover), r[2:]):
                column.append(x)
        return cls(tuple(f[1] for f in features), features[0][2], tuple(trees[t] for t in sorted(trees)))


def _thinned(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct values with their counts, if more than ``size``, those at even ranks stand for the others."""
    if len(values) <= size:
        return values, counts
    ranks = np.cumsum(counts)
    kept = np.unique(np.searchsorted(ranks, (np.arange(1, size + 1) * ranks[-1]) // size, side="left"))
    return values[kept], np.diff(ranks[kept], prepend=0)


def fit_cuts(df: DataFrame, features: Sequence[str], bins: int, midpoints: bool = False) -> list[np.ndarray]:
    """Cuts per feature: at most ``bins - 1`` of its own values, spread by rank, below its largest one.

    One pass over all features; a task sums its rows up by values with counts, and one task per
    feature merges these. A summary holds ``RANK_K`` values per bin: exact up to so many distinct
    ones, and within a fraction of a bin by rank beyond. A missing cell is an error. Fewer
    distinct values than bins give a cut at each of them but the last. ``midpoints`` moves a cut
    halfway to the next value.
    """
    if not features:
        return []
    size = max(RANK_K * bins, LEAST_K)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return _thinned(values, np.bincount(at, np.concatenate([c for _, c in parts]), len(values)).astype(np.int64), size)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts double in rows, so a value is thinned as often as the logarithm of the rows.
        waiting, rows = [], 0
        held: list[list] = [[] for _ in features]
        missing = np.zeros(len(features), np.int64)

        def taken() -> None:
            for i in range(len(features)):
                x = np.concatenate([w[i] for w in waiting])
                keep = x[~np.isnan(x)]
                missing[i] += len(x) - len(keep)
                part = (0, *_thinned(*np.unique(keep, return_counts=True), size))
                while held[i] and held[i][-1][0] == part[0]:
                    other = held[i].pop()
                    part = (part[0] + 1, *merged([other[1:], part[1:]]))
                held[i].append(part)

        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            rows += batch.num_rows
            if rows >= SUMMARY_ROWS:
                taken()
                waiting, rows = [], 0
        if waiting:
            taken()
        for i, parts in enumerate(held):
            if parts:
                values, counts = merged([p[1:] for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
                     pa.array([missing[i]], pa.int64())], names=["feature", "value", "rows", "missing"])

    def cut(parts: pd.DataFrame) -> pd.DataFrame:
        # Not thinned again: every task's summary is within its share of a bin.
        values = np.concatenate([np.frombuffer(v, float) for v in parts["value"]])
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in parts["rows"]])
        values, place = np.unique(values, return_inverse=True)
        ranks = np.cumsum(np.bincount(place, counts, len(values)).astype(np.int64))
        at = np.searchsorted(ranks, np.arange(1, bins) / bins * ranks[-1], side="left") if len(ranks) else np.zeros(0, int)
        at = np.unique(at[at < len(ranks) - 1])
        found = values[at]
        if midpoints:
            # A midpoint that is no number, or rounds up to the next value, would not keep them apart.
            between = found / 2 + values[at + 1] / 2
            found = np.where(np.isfinite(between) & (between >= found) & (between < values[at + 1]), between, found)
        return pd.DataFrame({
            "feature": [int(parts["feature"].iloc[0])], "missing": [int(parts["missing"].sum())], "cuts": [found.tolist()]})

    cells = df.select(*(F.col(f"`{f}`").cast("double").alias(f"__{i}") for i, f in enumerate(features)))
    found = {r["feature"]: r for r in cells.mapInArrow(
        summed, "feature int, value binary, rows binary, missing bigint").groupBy("feature").applyInPandas(
        cut, "feature int, missing bigint, cuts array<double>").collect()}
    missing = [f for i, f in enumerate(features) if i in found and found[i]["missing"]]
    if missing:
        raise ValueError(f"missing cells in {missing}; fill them before training")
    return [np.array(found[i]["cuts"] if i in found else [], float) for i in range(len(features))]


@contextmanager
def _few_blocks_a_batch(spark: SparkSession) -> Iterator[None]:
    """A block is a batch of rows itself: as many blocks as rows to a batch would be gigabytes in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _blocks(rows: DataFrame, cuts: list[np.ndarray], base: float) -> DataFrame:
    """Rows (label, weight, row, one column per feature) as blocks of binned cells, features x rows."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bins = np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, columns[3:])]).astype(np.uint8)
            parts = (
                bins, columns[0].astype(np.float64), columns[1].astype(np.float64), columns[2].astype(np.int64),
                np.full(batch.num_rows, base))
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=_BLOCK.replace(" binary", "").split(", "))

    return rows.mapInArrow(packed, _BLOCK)


def best_split(sums: np.ndarray, params: Params) -> tuple[float, int, int] | None:
    """The gain, feature and bin of a node's best split; of equal ones the first feature, then bin."""
    left = np.cumsum(sums, axis=1)
    total = left[:, -1:, :]
    right = total - left
    gain = (
        params.quality(left[..., 0], left[..., 1]) + params.quality(right[..., 0], right[..., 1])
        - params.quality(total[..., 0], total[..., 1]))
    gain[(left[..., 1] < params.child_weight) | (right[..., 1] < params.child_weight)] = -np.inf
    gain[:, -1] = -np.inf
    # Sums of the same rows in another order differ in their last digits.
    best = np.nanmax(gain)
    if not np.isfinite(best) or best <= LEAST_GAIN or best < params.gamma:
        return None
    feature, bin_ = np.unravel_index(np.argmax(gain >= best - 1e-12 * abs(best)), gain.shape)
    return float(gain[feature, bin_]), int(feature), int(bin_)


@dataclass(frozen=True)
class _SecondOrder:
    """Gradient and hessian of the logistic loss, and trees that gain most on them."""

    params: Params
    squares: bool = False
    rounds = property(lambda self: self.params.rounds)
    depth = property(lambda self: self.params.depth)
    bins = property(lambda self: self.params.bins)
    row_share = property(lambda self: self.params.row_share)
    seed = property(lambda self: self.params.seed)
    base = property(lambda self: self.params.base)

    def columns(self, round_: int, features: int) -> np.ndarray:
        draw = np.random.default_rng([self.params.seed, round_])
        return np.sort(draw.permutation(features)[:max(1, int(self.params.feature_share * features))])

    def rows(self, round_: int, margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        signed = np.where(label > 0, -margin, margin)
        small = np.exp(-np.abs(signed))
        # The share of the wrong class, from the smaller exponential.
        wrong = np.where(signed >= 0, 1.0, small) / (1 + small)
        return [np.where(label > 0, -weight, weight) * wrong, weight * small / (1 + small) ** 2], np.maximum(signed, 0) + np.log1p(small)

    def best(self, sums: np.ndarray, columns: np.ndarray, features: int, round_: int, node: int) -> tuple[float, int, int] | None:
        return best_split(sums, self.params)

    def value(self, sums: np.ndarray) -> float:
        return self.params.step * self.params.leaf(*sums)

    def cover(self, sums: np.ndarray) -> float:
        return sums[1]

    def divisible(self, sums: np.ndarray) -> bool:
        return sums[1] >= 2 * self.params.child_weight * (1 - 1e-9)

    def scale(self, round_: int) -> float:
        return 1.0


def _counted(
    blocks: DataFrame, tasks: int, objective: Objective, cuts: Sequence[np.ndarray], folder: str, save_every: int,
) -> tuple[list[Grown], list[float]]:
    return growing.grow(blocks, tasks, objective, cuts, folder, save_every)


def grown(
    df: DataFrame, features: Sequence[str], label: str, objective: Objective, weight: Column | None = None,
    identity: Column | None = None, midpoints: bool = False, one_class: bool = False,
) -> tuple[list[Grown], list[float]]:
    """The trees of an objective over complete rows, and the loss before each.

    ``identity`` is the hash that rows are drawn by; without it the row's own cells are hashed.    """
    spark = df.sparkSession
    if not 2 <= objective.bins <= 256:
        raise ValueError("bins are 2 to 256")
    y = F.col(f"`{label}`")
    counts = df.agg(F.count(F.lit(1)), F.count_if(y == 0), F.count_if(y == 1)).first()
    if counts[0] != counts[1] + counts[2]:
        raise ValueError("labels have to be 0 or 1")
    if not counts[0] if one_class else not counts[1] or not counts[2]:
        raise ValueError("no training rows" if one_class else "training rows hold one class only")
    cuts = fit_cuts(df, features, objective.bins, midpoints)
    cells = [F.col(f"`{f}`").cast("double") for f in features]
    rows = df.select(
        y.cast("double").alias("__label"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("__weight"),
        (F.xxhash64(y, *cells) if identity is None else identity).alias("__row"), *(c.alias(f"__{i}") for i, c in enumerate(cells)))
    path, told = scratch_path(spark, "boost-blocks"), scratch_path(spark, "boost-sums")
    # Few tasks for few rows, and otherwise one for every core: they run side by side.
    tasks = max(1, min(counts[0] // TASK_ROWS, growing.slots(spark)))
    blocks = write_stage(_blocks(rows, cuts, objective.base).repartition(tasks), path)
    try:
        with _few_blocks_a_batch(spark):
            return _counted(blocks, tasks, objective, cuts, told, REWRITE)
    finally:
        remove_path(spark, told)
        remove_path(spark, path)


def fit(
    df: DataFrame, features: Sequence[str], label: str = "label", params: Params = Params(), weight: Column | None = None,
    key: str | None = None,
) -> BoostedTrees:
    """Train on complete rows; a label that is null or neither 0 nor 1, or a missing cell, is an error.

    ``key`` names the column that identifies a row for drawing; without it the row's own
    cells do, and equal rows are drawn together. No rows, or labels of one class, are errors.
    """
    trees, losses = grown(df, features, label, _SecondOrder(params), weight, F.xxhash64(F.col(f"`{key}`")) if key else None)
    return BoostedTrees(tuple(features), params.base, tuple(g.tree for g in trees), tuple(losses))
