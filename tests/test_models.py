import itertools
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.operators import explain, scoring
from faultline.plans import models as plans
from faultline.sources import models as store, predictions as predictions_store, tables

FEATURES = ["a", "b", "c"]


def _data(n=600):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=n), rng.exponential(size=n), rng.integers(0, 5, n).astype(float)])
    y = (x[:, 0] + 0.5 * x[:, 1] - 0.3 * x[:, 2] + rng.normal(size=n) > 0.9).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark):
    x, y = _data()
    rows = [(f"k{i}", *map(float, x[i]), int(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "row_key string, a double, b double, c double, label int").repartition(3).cache()


@pytest.fixture(scope="module")
def boosted(frame):
    return scoring.train_boosted(frame, FEATURES, params=scoring.BoostParams(rounds=4, depth=3, step=0.3, bins=16))


@pytest.mark.parametrize("balanced", [False, True])
def test_logreg_is_the_minimum_of_the_penalised_loss(frame, balanced):
    """The gradient of C = 1 on population-scaled features is zero at our solution."""
    model = scoring.train_logreg(frame, FEATURES, balanced=balanced)
    x, y = _data()
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    shrink = math.sqrt((len(y) - 1) / len(y))
    beta = np.array(model.stages[-1].coefficients) * shrink
    p = 1 / (1 + np.exp(-(z @ beta + model.stages[-1].intercept)))
    gradient = z.T @ (w * (p - y)) + beta
    assert np.abs(gradient).max() < 1e-3 and abs(np.sum(w * (p - y))) < 1e-3
    have = {r[0]: r[1] for r in scoring.score_proba(model, frame, ["row_key"]).collect()}
    assert np.allclose([have[f"k{i}"] for i in range(len(y))], p, atol=1e-6)


def test_one_class_is_an_error(frame):
    with pytest.raises(ValueError, match="one class"):
        scoring.train_logreg(frame.filter("label = 0"), FEATURES)


def _brute_shapley(table_rows, weights, row, n):
    """Shapley values by all subsets; unknown features follow both children by cover."""
    def value(known):
        total = 0.0
        for tree, weight in enumerate(weights):
            nodes = table_rows[tree]

            def walk(i):
                node = nodes[i]
                if node["left"] < 0:
                    return node["value"]
                if node["feature"] in known:
                    return walk(node["left"] if row[node["feature"]] <= node["cut"] else node["right"])
                a, b = nodes[node["left"]]["cover"], nodes[node["right"]]["cover"]
                return (walk(node["left"]) * a + walk(node["right"]) * b) / (a + b)

            total += 2 * weight * walk(0)
        return total

    out = []
    for j in range(n):
        others = [i for i in range(n) if i != j]
        phi = 0.0
        for k in range(n):
            for s in itertools.combinations(others, k):
                share = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                phi += share * (value({*s, j}) - value(set(s)))
        out.append(phi)
    return value(set()), out


def test_contributions_equal_brute_force(spark, frame, boosted):
    path = tempfile.mkdtemp(prefix="run-") + "/m"
    trees = boosted.stages[-1]
    trees.write().save(path)
    rows: dict = {}
    for r in spark.read.parquet(path + "/data").collect():
        n = r["nodeData"]
        cut = n["split"]["leftCategoriesOrThreshold"]
        rows.setdefault(r["treeID"], {})[n["id"]] = {
            "left": n["leftChild"], "right": n["rightChild"], "value": n["prediction"], "cover": n["impurityStats"][0],
            "feature": n["split"]["featureIndex"], "cut": cut[0] if cut else None}
    explained = explain.tree_shap(boosted, frame, ["row_key"]).limit(12).collect()
    for r in explained:
        base, phi = _brute_shapley(rows, trees.treeWeights, [r[f] for f in FEATURES], 3)
        assert r["base_value"] == pytest.approx(base, abs=1e-10)
        assert np.allclose(r[explain.PHI], phi, atol=1e-10)


def test_contributions_add_up_to_the_log_odds(frame, boosted):
    scored = scoring.score(boosted, frame)
    for r in explain.tree_shap(boosted, scored, ["failure_probability"]).collect():
        p = r["failure_probability"]
        assert r["base_value"] + sum(r[explain.PHI]) == pytest.approx(math.log(p / (1 - p)), abs=1e-9)


def test_contributions_follow_infinite_cells_and_refuse_missing_ones(spark, frame, boosted):
    rows = spark.createDataFrame(
        [("low", float("-inf"), 1.0, 2.0), ("high", float("inf"), float("inf"), 0.0), ("both", float("-inf"), float("inf"), 1.0)],
        "row_key string, a double, b double, c double")
    scored = scoring.score(boosted, rows)
    for r in explain.tree_shap(boosted, scored, ["failure_probability"]).collect():
        p = r["failure_probability"]
        assert r["base_value"] + sum(r[explain.PHI]) == pytest.approx(math.log(p / (1 - p)), abs=1e-9)
    with pytest.raises(Exception, match="a feature is missing"):
        explain.tree_shap(boosted, rows.withColumn("b", F.lit(None).cast("double"))).collect()


def test_the_tree_table_of_a_large_model_is_quick(frame):
    import time

    model = scoring.train_boosted(frame, FEATURES, params=scoring.BoostParams(rounds=3, depth=5, bins=16))
    table = explain.tree_table(model)
    large = explain.TreeTable(table.trees * 100, table.base, table.features)
    start = time.perf_counter()
    explain._contributions(large, np.random.default_rng(1).normal(size=(1000, 3)))
    assert time.perf_counter() - start < 20 and sum(map(len, large.trees)) > 1000


def test_explanation_tables(frame, boosted):
    result = plans.explain_model(boosted, frame, n=200)
    ranks = [r["rank"] for r in result.importance.collect()]
    assert ranks == [1, 2, 3]
    highest = result.highest.collect()
    top = scoring.score(boosted, frame).agg(F.max("failure_probability")).collect()[0][0]
    assert len(highest) == 3 and highest[0]["risk_probability"] <= top
    sizes = [r["absolute_shap"] for r in highest]
    assert sizes == sorted(sizes, reverse=True)


def test_saved_model_scores_alike_and_keeps_the_order(frame, boosted):
    path = tempfile.mkdtemp(prefix="run-") + "/model"
    store.save_model(boosted, path)
    model, features = store.load_model(path)
    assert features == FEATURES
    before = sorted(tuple(r) for r in scoring.score_proba(boosted, frame, ["row_key"]).collect())
    assert before == sorted(tuple(r) for r in scoring.score_proba(model, frame, ["row_key"]).collect())
    with pytest.raises(FileNotFoundError):
        store.load_model(path + "-absent")


def test_weights(frame):
    _, y = _data()
    weights = scoring.fit_class_weights(frame)
    assert weights.ratio == pytest.approx((1 - y).sum() / y.sum())
    rows = {r["label"]: r["class_weight"] for r in scoring.balanced_class_weight(frame).collect()}
    assert rows[1] == pytest.approx(len(y) / (2 * y.sum()))


def test_batches_and_reruns(spark, frame, boosted):
    root = tempfile.mkdtemp(prefix="run-")
    store.save_model(boosted, root + "/model")
    source = frame.drop("label").selectExpr("row_key", "cast(a as string) as A", "if(b > 2, 'na', cast(b as string)) as B", "c as C")
    for batch in ("one", "two", "two"):
        done = plans.batch_score(source, root + "/model", root + "/table", batch)
    stored = done.stored
    assert done.rows == frame.count() and done.filled_cells == frame.filter("b > 2").count()
    everything = predictions_store.read_predictions(spark, root + "/table")
    assert [f.name for f in everything.schema] == [f.name for f in S.PREDICTIONS]
    n = frame.count()
    ids = sorted(r[0] for r in everything.select("prediction_id").collect())
    assert ids == list(range(1, 2 * n + 1))
    assert stored.count() == n and stored.filter("failure_probability is null").count() == 0
    assert stored.select("row_key").distinct().count() == n


def test_metrics_history(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/metrics"
    one = spark.createDataFrame([(10, 0.5, 0.25)], "test_rows long, precision double, recall double")
    for run in ("a", "b", "a"):
        tables.append_metrics(one, path, run_id=run, model="m", dataset="d", train_rows=40, features=3)
    rows = {(r["run_id"], r["metric"]): r["value"] for r in tables.read_metrics(spark, path).collect()}
    assert rows == {("a", "precision"): 0.5, ("a", "recall"): 0.25, ("b", "precision"): 0.5, ("b", "recall"): 0.25}


def test_small_files_and_csv(spark):
    root = tempfile.mkdtemp(prefix="run-")
    tables.write_small(spark.range(5).repartition(4), root + "/t", "csv")
    assert spark.read.option("header", True).csv(root + "/t").count() == 5


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """Rows that lie in two of eight parts reach all cores; few rows stay in one part, more than a part holds make more."""
    rows = spark.range(0, 8_000, 1, 8).where("id < 2000").selectExpr("CAST(id AS DOUBLE) AS a", "id % 2 AS label")

    def parts(df):
        return sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())

    monkeypatch.setattr(scoring, "PART_ROWS", (100, 1_000))
    cores = spark.sparkContext.defaultParallelism
    assert len(parts(rows)) == 2
    even = parts(scoring._dealt(rows))
    assert len(even) == cores and max(even) <= 1.2 * 2_000 / cores and sum(even) == 2_000
    monkeypatch.setattr(scoring, "PART_ROWS", (10, 100))
    many = parts(scoring._dealt(rows))
    assert len(many) % cores == 0 and max(many) <= 120 and sum(many) == 2_000
    monkeypatch.setattr(scoring, "PART_ROWS", (20_000, 1_000_000))
    assert parts(scoring._dealt(rows)) == [2_000]
