"""Boosted trees against MLlib's own training."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from faultline.operators import boosting, scoring

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    n = 3_000
    x = np.column_stack([draw.integers(0, 40, n), draw.integers(0, 9, n) / 4, draw.normal(size=n).round(1)])
    y = (x[:, 0] / 20 + x[:, 1] - x[:, 2] + draw.normal(size=n) > 3.0).astype(int)
    frame = pd.DataFrame(x.astype(float), columns=FEATURES).assign(label=y, row_key=[f"k{i}" for i in range(n)])
    return spark.createDataFrame(frame).repartition(5).cache()


def _probabilities(model, rows):
    scored = model.transform(rows).select("row_key", vector_to_array("probability")[1].alias("p"))
    return np.array([r["p"] for r in scored.orderBy("row_key").collect()])


@pytest.mark.parametrize("weighted, min_rows", [(False, 1), (True, 60)])
def test_all_rows_and_features_give_the_librarys_own_model(rows, monkeypatch, weighted, min_rows):
    monkeypatch.setattr(boosting, "TASK_ROWS", 700)
    params = scoring.BoostParams(rounds=5, depth=4, step=0.3, row_share=1.0, feature_share=1.0, min_rows=min_rows)
    mine = scoring.train_boosted(rows, FEATURES, params=params, weighted=weighted)
    plain = GBTClassifier(
        maxIter=5, maxDepth=4, stepSize=0.3, featureSubsetStrategy="all", minInstancesPerNode=min_rows, maxBins=256, seed=1)
    train = rows.withColumn("w", scoring.fit_class_weights(rows).scaled())
    want = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), plain.setWeightCol("w") if weighted else plain]).fit(train)
    assert np.allclose(_probabilities(mine, rows), _probabilities(want, train), atol=1e-9)
    for a, b in zip(mine.stages[-1].trees, want.stages[-1].trees):
        assert (a.numNodes, a.depth) == (b.numNodes, b.depth)
    assert mine.stages[-1].treeWeights == want.stages[-1].treeWeights
    assert np.allclose(mine.stages[-1].featureImportances.toArray(), want.stages[-1].featureImportances.toArray(), atol=1e-9)
    assert mine.stages[-1].getMaxIter() == 5 and mine.stages[-1].getMinInstancesPerNode() == min_rows


def test_drawn_rows_and_features_differ_by_tree_and_all_are_used(rows):
    params = scoring.BoostParams(rounds=6, depth=2, step=0.1, row_share=0.5, feature_share=0.3, bins=16)
    model = scoring.train_boosted(rows, FEATURES, params=params).stages[-1]
    nodes = [t.toDebugString for t in model.trees]
    assert {f for f in range(3) for n in nodes if f"feature {f} " in n} == {0, 1, 2}
    drawn = [t._call_java("rootNode").impurityStats().count() for t in model.trees]
    assert len(set(drawn)) > 1 and all(0.4 * 3_000 < d < 0.6 * 3_000 for d in drawn)


def test_walking_rows_equals_walking_all_nodes(rows):
    from faultline.plans import checks

    model = scoring.train_boosted(rows, FEATURES, params=scoring.BoostParams(rounds=3, depth=5, step=0.3))
    trees, _ = checks.saved_trees(rows.sparkSession, model)
    x = np.array([tuple(r) for r in rows.select(*FEATURES).limit(500).collect()])
    for nodes in [*trees, {0: {"left": -1, "value": 2.5}}]:
        assert np.array_equal(checks._values(nodes, x), checks._walk(nodes, 0, x, frozenset(range(3))))
