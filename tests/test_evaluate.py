import numpy as np
import pytest

from faultline.operators import evaluate

# A published threshold table (threshold, precision, recall, f1, fp, fn, tp, tn).
SWEEP = [
    (0.1, 0.3922, 0.955, 0.556, 296, 9, 191, 11504), (0.15, 0.4381, 0.955, 0.6006, 245, 9, 191, 11555),
    (0.2, 0.4751, 0.955, 0.6346, 211, 9, 191, 11589), (0.25, 0.5026, 0.955, 0.6586, 189, 9, 191, 11611),
    (0.3, 0.5235, 0.945, 0.6738, 172, 11, 189, 11628), (0.35, 0.5565, 0.935, 0.6978, 149, 13, 187, 11651),
    (0.4, 0.5736, 0.935, 0.711, 139, 13, 187, 11661), (0.45, 0.5968, 0.925, 0.7255, 125, 15, 185, 11675),
    (0.5, 0.6216, 0.92, 0.7419, 112, 16, 184, 11688), (0.55, 0.6512, 0.915, 0.7609, 98, 17, 183, 11702),
    (0.6, 0.6753, 0.915, 0.7771, 88, 17, 183, 11712), (0.65, 0.7087, 0.9, 0.793, 74, 20, 180, 11726),
    (0.7, 0.7257, 0.86, 0.7872, 65, 28, 172, 11735), (0.75, 0.7478, 0.845, 0.7934, 57, 31, 169, 11743),
    (0.8, 0.7915, 0.835, 0.8127, 44, 33, 167, 11756), (0.85, 0.8079, 0.82, 0.8139, 39, 36, 164, 11761),
    (0.9, 0.8298, 0.78, 0.8041, 32, 44, 156, 11768),
]
NAMES = ["threshold", "precision", "recall", "f1", "false_positives", "false_negatives", "true_positives", "true_negatives"]


def _brute(p, y):
    """AUC by pairs, average precision by walking the distinct scores."""
    pos, neg = p[y == 1], p[y == 0]
    auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = np.sum((p >= t) & (y == 1))
        ap += (tp / len(pos) - last) * tp / np.sum(p >= t)
        last = tp / len(pos)
    return auc, ap


def _scored(spark, n=700, hot=0.33):
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(1, 3, n), 2)
    p[rng.random(n) < hot] = 1.0
    y = (rng.random(n) < 0.2 + 0.4 * p).astype(int)
    return p, y, spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, label int")


@pytest.mark.parametrize("ranges", ["1", "8", "30"])
def test_areas(spark, ranges):
    p, y, df = _scored(spark)
    auc, ap = _brute(p, y)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        row = evaluate.model_metrics(df, "p").collect()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12) and row["average_precision"] == pytest.approx(ap, abs=1e-12)
    assert row["true_positives"] == np.sum((p >= 0.5) & (y == 1))


def test_degenerate_inputs(spark):
    one = spark.createDataFrame([(0.2, 0), (0.4, 0)], "p double, label int")
    assert evaluate.roc_auc(one, "p").collect()[0][0] is None
    assert evaluate.average_precision(one, "p").collect()[0][0] == 0.0
    equal = spark.createDataFrame([(0.3, 0), (0.3, 1), (0.3, 0)], "p double, label int")
    assert evaluate.roc_auc(equal, "p").collect()[0][0] == 0.5
    rates = evaluate.precision_recall_f1(evaluate.confusion_matrix(one.selectExpr("label", "0 as prediction"))).collect()[0]
    assert tuple(rates) == (0.0, 0.0, 0.0)


def test_published_rates_follow_from_the_counts(spark):
    df = spark.createDataFrame(SWEEP, NAMES)
    rates = evaluate.precision_recall_f1(df, ["threshold"]).orderBy("threshold").collect()
    for row, want in zip(rates, SWEEP):
        assert [round(row[n], 4) for n in ("precision", "recall", "f1")] == list(want[1:4])


def test_published_choice(spark):
    df = spark.createDataFrame(SWEEP, NAMES)
    best = evaluate.select_threshold(df).collect()[0]
    assert (best["threshold"], best["f1"]) == (0.65, 0.793)
    strict = evaluate.select_threshold(df, min_recall=0.99).collect()[0]
    assert (strict["threshold"], strict["recall"]) == (0.1, 0.955)


def test_published_confusion_matrix(spark):
    counts = spark.createDataFrame([(11486, 314, 18, 182)], [
        "true_negatives", "false_positives", "false_negatives", "true_positives"])
    row = evaluate.precision_recall_f1(counts).collect()[0]
    assert [round(v, 4) for v in row] == [0.3669, 0.91, 0.523]
    report = {(r["class"], r["metric"]): round(r["value"], 2) for r in evaluate.classification_report(counts).collect()}
    # The published report, two decimals.
    assert [report["Normal", m] for m in ("precision", "recall", "f1-score", "support")] == [1.0, 0.97, 0.99, 11800]
    assert [report["Failure", m] for m in ("precision", "recall", "f1-score", "support")] == [0.37, 0.91, 0.52, 200]
    assert [report["macro avg", m] for m in ("precision", "recall", "f1-score", "support")] == [0.68, 0.94, 0.75, 12000]
    assert [report["weighted avg", m] for m in ("precision", "recall", "f1-score")] == [0.99, 0.97, 0.98]


def test_sweep_equals_one_pass_per_threshold(spark):
    p, y, df = _scored(spark)
    for row in evaluate.threshold_sweep(df, "p").collect():
        hit = p >= row["threshold"]
        assert row["true_positives"] == np.sum(hit & (y == 1)) and row["false_positives"] == np.sum(hit & (y == 0))
        assert row["false_negatives"] == np.sum(~hit & (y == 1)) and row["true_negatives"] == np.sum(~hit & (y == 0))


def test_published_comparison(spark):
    # Published scores of two models.
    scores = {"linear": (0.9225, 0.9617, 0.8800, 0.9191, 0.9712), "trees": (0.9825, 0.9849, 0.9800, 0.9825, 0.9981)}
    measures = ("accuracy", "precision", "recall", "f1", "roc_auc")
    df = spark.createDataFrame([(m, n, v) for m, vs in scores.items() for n, v in zip(measures, vs)], ["model", "metric", "value"])
    rows = {r["model"]: r for r in evaluate.model_comparison(df, "linear").collect()}
    assert [rows["trees"][f"{m}_points"] for m in measures] == [6.0, 2.32, 10.0, 6.34, 2.69]
    assert rows["trees"]["is_best"] and not rows["linear"]["is_best"]
