"""Independent recomputation of model results, for the registered checks.

Nothing here calls what it checks: scores come from coefficients or from walking the saved
trees, contributions from all subsets of features.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.session import scratch_path, scratch_scope


def logistic_probability(model: PipelineModel, features: Sequence[str]) -> Column:
    """The probability of a logistic pipeline as a column expression over its inputs."""
    _, scaler, regression = model.stages
    margin = F.lit(float(regression.intercept))
    for f, mean, deviation, weight in zip(features, scaler.mean, scaler.std, regression.coefficients):
        margin = margin + (F.col(f) - float(mean)) * (float(weight) / float(deviation) if deviation else 0.0)
    return 1 / (1 + F.exp(-margin))


def logistic_gradient(train: DataFrame, model: PipelineModel, features: Sequence[str], balanced: bool) -> DataFrame:
    """Largest absolute derivative of the C = 1 loss, features scaled by population deviation, in one row."""
    _, scaler, regression = model.stages
    totals = train.agg(F.count(F.lit(1)), F.sum("label")).collect()[0]
    n, positives = float(totals[0]), float(totals[1])
    shrink = math.sqrt((n - 1) / n)
    weight = F.when(F.col("label") == 1, n / (2 * positives)).otherwise(n / (2 * (n - positives))) if balanced else F.lit(1.0)
    miss = weight * (logistic_probability(model, features) - F.col("label"))
    parts = [F.abs(F.sum(miss))]
    for f, mean, deviation, beta in zip(features, scaler.mean, scaler.std, regression.coefficients):
        if deviation:
            z = (F.col(f) - float(mean)) / (float(deviation) * shrink)
            parts.append(F.abs(F.sum(miss * z) + float(beta) * shrink))
    return train.agg(F.greatest(*parts).alias("largest"))


def saved_trees(spark: SparkSession, model: PipelineModel) -> tuple[list[dict[int, dict]], list[float]]:
    """Node rows by tree and the tree weights of a boosted pipeline."""
    trees = model.stages[-1]
    with scratch_scope(spark):
        path = scratch_path(spark, "check-trees")
        trees.write().save(path)
        rows = spark.read.parquet(f"{path}/data").collect()
    out: list[dict[int, dict]] = [{} for _ in trees.treeWeights]
    for r in rows:
        n = r["nodeData"]
        cut = n["split"]["leftCategoriesOrThreshold"]
        out[r["treeID"]][n["id"]] = {
            "left": n["leftChild"], "right": n["rightChild"], "value": n["prediction"], "cover": n["impurityStats"][0],
            "feature": n["split"]["featureIndex"], "cut": cut[0] if cut else None}
    return out, list(trees.treeWeights)


def _walk(nodes: dict[int, dict], at: int, x: np.ndarray, known: frozenset[int]) -> np.ndarray:
    """Values of rows at a node; features outside ``known`` follow both children by cover."""
    node = nodes[at]
    if node["left"] < 0:
        return np.full(len(x), node["value"])
    left, right = (_walk(nodes, node[side], x, known) for side in ("left", "right"))
    if node["feature"] not in known:
        a, b = nodes[node["left"]]["cover"], nodes[node["right"]]["cover"]
        return (left * a + right * b) / (a + b)
    return np.where(x[:, node["feature"]] <= node["cut"], left, right)


def _values(nodes: dict[int, dict], x: np.ndarray) -> np.ndarray:
    """Values of rows; each row goes its own way down the tree."""
    size = max(nodes) + 1
    feature, ways, cut, value, level = np.zeros(size, int), np.repeat(np.arange(size), 2), np.zeros(size), np.zeros(size), np.zeros(size, int)
    waiting = [0]
    for n in waiting:
        node = nodes[n]
        value[n] = node["value"]
        if node["left"] >= 0:
            feature[n], cut[n], ways[2 * n], ways[2 * n + 1] = node["feature"], node["cut"], node["right"], node["left"]
            level[[node["left"], node["right"]]] = level[n] + 1
            waiting += [node["left"], node["right"]]
    at, cells, start = np.zeros(len(x), int), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(level.max()):
        at = ways[2 * at + (cells[start + feature[at]] <= cut[at])]
    return value[at]


def margin(trees: list[dict[int, dict]], weights: list[float], x: np.ndarray, known: frozenset[int] | None = None) -> np.ndarray:
    """Log-odds of rows; this library's margin is twice the sum of its trees."""
    return sum(2 * w * (_values(nodes, x) if known is None else _walk(nodes, 0, x, known)) for nodes, w in zip(trees, weights))


def boosted_probability(scored: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Add ``walked``: each row's probability from walking the saved trees."""
    trees, weights = saved_trees(scored.sparkSession, model)
    names = list(features)

    @F.pandas_udf("double")
    def walked(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(1 / (1 + np.exp(-margin(trees, weights, x))))

    return scored.withColumn("walked", walked(*(F.col(f).cast("double") for f in names)))


def shapley_by_subsets(explained: DataFrame, model: PipelineModel, features: Sequence[str], phi: str) -> DataFrame:
    """Add ``distance``: the largest gap between the contributions and those over all subsets of features."""
    trees, weights = saved_trees(explained.sparkSession, model)
    names, d = list(features), len(features)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(float)
            value = {frozenset(s): margin(trees, weights, x, frozenset(s)) for k in range(d + 1) for s in itertools.combinations(range(d), k)}
            gaps = [np.abs(batch["base_value"].to_numpy() - value[frozenset()])]
            given = np.array(batch[phi].tolist()).reshape(len(batch), d)
            for j in range(d):
                others = [i for i in range(d) if i != j]
                want = np.zeros(len(x))
                for k in range(d):
                    share = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                    for s in itertools.combinations(others, k):
                        want += share * (value[frozenset({*s, j})] - value[frozenset(s)])
                gaps.append(np.abs(given[:, j] - want))
            yield pd.DataFrame({"distance": np.max(gaps, axis=0)})

    return explained.mapInPandas(compare, "distance double")


def stored_trees(spark: SparkSession, path: str) -> list[dict[int, dict]]:
    """Node rows by tree of a stored second-order model."""
    out: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/nodes").collect():
        out.setdefault(r["tree"], {})[r["node"]] = r.asDict()
    return [out[t] for t in sorted(out)]


def _reached(nodes: dict[int, dict], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), int)
    for node in sorted(nodes):
        if nodes[node]["left"] >= 0:
            here = at == node
            low = x[:, nodes[node]["feature"]] <= nodes[node]["cut"]
            at[here & low], at[here & ~low] = nodes[node]["left"], nodes[node]["right"]
    return at


def second_order_margins(df: DataFrame, trees: list[dict[int, dict]], features: Sequence[str], after: Sequence[int]) -> DataFrame:
    """Add ``margins``: each row's log-odds after so many trees, from walking them."""
    names, wanted = list(features), list(after)

    @F.pandas_udf("array<double>")
    def walked(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        total, out = np.zeros(len(x)), []
        for t in range(max(wanted) + 1):
            if t in wanted:
                out.append(total.copy())
            if t < len(trees):
                total = total + _values(trees[t], x)
        return pd.Series(list(np.column_stack(out)))

    return df.withColumn("margins", walked(*(F.col(f).cast("double") for f in names)))


def second_order_leaves(train: DataFrame, trees: list[dict[int, dict]], features: Sequence[str], weight: Column) -> DataFrame:
    """Sums of gradient and hessian by tree and leaf: (tree, leaf, g, h)."""
    names = list(features)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y, w = batch[names].to_numpy(float), batch["label"].to_numpy(float), batch["w"].to_numpy(float)
            total = np.zeros(len(x))
            for t, nodes in enumerate(trees):
                p = 1 / (1 + np.exp(-total))
                leaf = _reached(nodes, x)
                yield pd.DataFrame({"tree": t, "leaf": leaf, "g": w * (p - y), "h": w * p * (1 - p)}).groupby(
                    ["tree", "leaf"], as_index=False).sum()
                total = total + _values(nodes, x)

    rows = train.select(*(F.col(f).cast("double").alias(f) for f in names), F.col("label").cast("double"), weight.alias("w"))
    return rows.mapInPandas(sums, "tree int, leaf int, g double, h double").groupBy("tree", "leaf").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"))
