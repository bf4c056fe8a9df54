"""Classifier quality from scored rows: counts, curves, thresholds, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import schema as S
from faultline.functions import expressions as X
from faultline.sources.tables import stage

MEASURES = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label), F.col(prediction)

    def cell(actual: int, predicted: int, name: str) -> Column:
        return F.count_if((y == actual) & (p == predicted)).alias(name)

    return df.groupBy(*by).agg(
        cell(0, 0, "true_negatives"), cell(0, 1, "false_positives"),
        cell(1, 0, "false_negatives"), cell(1, 1, "true_positives"),
    )


def _cells() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))


def _precision(tp, fp):
    return X.safe_ratio(tp, tp + fp)


def _recall(tp, fn):
    return X.safe_ratio(tp, tp + fn)


def _f1(tp, fp, fn):
    return X.safe_ratio(2 * tp, 2 * tp + fp + fn)


def accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = _cells()
    return counts.select(*by, X.safe_ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"))


def precision_recall_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    _, fp, fn, tp = _cells()
    return counts.select(
        *by, _precision(tp, fp).alias("precision"), _recall(tp, fn).alias("recall"), _f1(tp, fp, fn).alias("f1"))


def classification_report(counts: DataFrame, names: Sequence[str] = ("Normal", "Failure")) -> DataFrame:
    """Long form ``(class, metric, value)``: both classes, accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (c.cast("double") for c in _cells())
    n = tn + fp + fn + tp
    per_class = [
        (names[0], _precision(tn, fn), _recall(tn, fp), _f1(tn, fn, fp), tn + fp),
        (names[1], _precision(tp, fp), _recall(tp, fn), _f1(tp, fp, fn), tp + fn),
    ]
    metrics = ("precision", "recall", "f1-score", "support")
    entries = [(name, m, v) for name, *values in per_class for m, v in zip(metrics, values)]
    entries.append(("accuracy", "accuracy", X.safe_ratio(tp + tn, n)))
    (_, *a, sa), (_, *b, sb) = per_class
    for m, u, v in zip(metrics, a, b):
        entries.append(("macro avg", m, (u + v) / 2))
        entries.append(("weighted avg", m, X.safe_ratio(u * sa + v * sb, n)))
    for name in ("macro avg", "weighted avg"):
        entries.append((name, "support", n))
    return counts.select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("class"), F.lit(m).alias("metric"), v.alias("value")) for c, m, v in entries
    ))))


def score_curve(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: its positives and negatives, and both counts at or above it.

    Equal scores are merged before the shuffle, dealt out in ranges of the score and
    written once, so the scores are computed once. The running sums are cut at the ranges:
    a sum per range, a running sum over the ranges, and one inside each range. No task sees
    all scores; there are as many ranges as shuffle partitions.
    """
    by = list(by)
    scored = df.select(*by, X.not_nan(score).alias("score"), F.col(label).cast("int").alias("label")).filter(
        F.col("score").isNotNull() & F.col("label").isNotNull())
    counts = scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(ranges, *by, F.desc("score"))
    grouped = stage(dealt.withColumn("range", F.spark_partition_id()), "score-ranges")
    inside = W.partitionBy(*by, "range").orderBy(F.desc("score"))
    curve = grouped.withColumn("pos_upto", F.sum("pos").over(inside)).withColumn("neg_upto", F.sum("neg").over(inside))
    above = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = grouped.groupBy(*by, "range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        *(F.col(c).alias(f"__{c}") for c in by), F.col("range").alias("__range"),
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("neg_above"),
    )
    same = F.col("range") == F.col("__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return curve.join(sums, same).select(
        *by, "score", "pos", "neg",
        (F.col("pos_upto") + F.col("pos_above")).alias("pos_upto"),
        (F.col("neg_upto") + F.col("neg_above")).alias("neg_upto"),
    )


def _auc() -> Column:
    pairs = F.col("neg").cast("double") * (F.col("pos_upto") - F.col("pos") / 2)
    return F.try_divide(F.sum(pairs), F.sum("pos").cast("double") * F.sum("neg"))


def _average_precision() -> Column:
    at = F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    return F.coalesce(F.try_divide(F.sum(F.col("pos") * at), F.sum("pos").cast("double")), F.lit(0.0))


def roc_auc(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """P(positive scores higher) plus half the ties; null with one class only."""
    return score_curve(df, score, label, by).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Recall steps weighted by precision, without interpolation."""
    return score_curve(df, score, label, by).groupBy(*by).agg(
        _average_precision().alias("average_precision"))


def model_metrics(
    df: DataFrame, score: str, label: str = "label", threshold: float = S.CLASS_CUTOFF, by: Sequence[str] = (),
) -> DataFrame:
    """Counts, rates and both areas in one row per group, all from one score curve."""
    hit = F.col("score") >= F.lit(float(threshold))

    def cell(column: str, test: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).cast("bigint").alias(name)

    counts = score_curve(df, score, label, by).groupBy(*by).agg(
        cell("neg", ~hit, "true_negatives"), cell("neg", hit, "false_positives"),
        cell("pos", ~hit, "false_negatives"), cell("pos", hit, "true_positives"),
        _auc().alias("roc_auc"), _average_precision().alias("average_precision"),
    )
    tn, fp, fn, tp = _cells()
    return counts.select(
        *by, (tn + fp + fn + tp).alias("test_rows"),
        "true_negatives", "false_positives", "false_negatives", "true_positives",
        X.safe_ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _precision(tp, fp).alias("precision"), _recall(tp, fn).alias("recall"), _f1(tp, fp, fn).alias("f1"),
        "roc_auc", "average_precision",
    )


def default_threshold_eval(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    return model_metrics(df, score, label, S.CLASS_CUTOFF)


def threshold_sweep(
    df: DataFrame, score: str, label: str = "label", hundredths: Sequence[int] = S.SWEEP_HUNDREDTHS,
) -> DataFrame:
    """Rates and counts at every threshold.

    Each row is placed once, by how many thresholds it passes; the counts at a
    threshold are sums over those few groups, so the data is neither read nor
    multiplied once per threshold.
    """
    p, y = X.not_nan(score), F.col(label)
    cuts = [h / 100 for h in sorted(hundredths)]
    passed = sum((F.coalesce(p >= F.lit(t), F.lit(False)).cast("int") for t in cuts), F.lit(0))
    groups = df.select(passed.alias("passed"), y.alias("label")).groupBy("passed").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))

    def total(column: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).cast("bigint")

    wide = []
    for i in range(1, len(cuts) + 1):
        reached = F.col("passed") >= i
        wide += [
            total("neg", reached).alias(f"fp{i}"), total("pos", ~reached).alias(f"fn{i}"),
            total("pos", reached).alias(f"tp{i}"), total("neg", ~reached).alias(f"tn{i}"),
        ]
    rows = groups.agg(*wide).select(F.inline(F.array(*(
        F.struct(
            F.lit(t).alias("threshold"),
            F.col(f"fp{i}").alias("false_positives"), F.col(f"fn{i}").alias("false_negatives"),
            F.col(f"tp{i}").alias("true_positives"), F.col(f"tn{i}").alias("true_negatives"),
        ) for i, t in enumerate(cuts, start=1)
    ))))
    _, fp, fn, tp = _cells()
    return rows.select(
        "threshold",
        F.round(_precision(tp, fp), 4).alias("precision"),
        F.round(_recall(tp, fn), 4).alias("recall"),
        F.round(_f1(tp, fp, fn), 4).alias("f1"),
        "false_positives", "false_negatives", "true_positives", "true_negatives",
    ).orderBy("threshold")


def select_threshold(sweep: DataFrame, min_recall: float = S.MIN_RECALL) -> DataFrame:
    """Best F1 among thresholds with enough recall, else the best recall.

    Works on the rounded values of the sweep; the lowest threshold wins a tie.
    """
    eligible = F.col("recall") >= F.lit(min_recall)
    return sweep.orderBy(
        F.desc(eligible.cast("int")),
        F.desc(F.when(eligible, F.col("f1")).otherwise(F.col("recall"))),
        F.asc("threshold"),
    ).limit(1)


def long_metrics(metrics: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    return metrics.unpivot(list(keys), list(measures), "metric", "value")


def model_comparison(
    metrics: DataFrame, baseline: str,
    measures: Sequence[str] = ("accuracy", "precision", "recall", "f1", "roc_auc"), best_by: str = "f1",
) -> DataFrame:
    """Models side by side, their lead over the baseline in percentage points, the best one marked.

    The input is long, ``(model, metric, value)``, with a row per model and metric.
    """
    wide = metrics.groupBy("model").pivot("metric", list(measures)).agg(F.first("value"))
    models = W.partitionBy()

    def lead(m: str) -> Column:
        base = F.max(F.when(F.col("model") == baseline, F.col(m))).over(models)
        return F.round((F.col(m) - base) * 100, 2).alias(f"{m}_points")

    best = (F.row_number().over(models.orderBy(F.desc(best_by), "model")) == 1).alias("is_best")
    return wide.select("model", *(F.round(m, 4).alias(m) for m in measures), *(lead(m) for m in measures), best)
