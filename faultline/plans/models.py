"""Train, score, store, evaluate and explain, end to end."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from faultline import schema as S
from faultline.operators import clean, evaluate, explain, sample, scoring
from faultline.sources import models, predictions, tables
from faultline.sources.tables import stage


def labelled(df: DataFrame, features: Sequence[str], target: str = S.CLASS) -> DataFrame:
    """Numeric features and a 0/1 ``label``; rows with a missing one are dropped."""
    typed = clean.encode_target(clean.to_numeric(df), target, "label")
    return clean.drop_incomplete_rows(typed, features)


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    scored: DataFrame
    metrics: DataFrame
    sweep: DataFrame
    threshold: DataFrame


def train_and_evaluate(
    split: DataFrame, features: Sequence[str], train: Callable[..., PipelineModel], label: str = "label", **options,
) -> Trained:
    """Fit on the train side, score the test side, measure it, sweep the thresholds, choose one."""
    model = train(split.filter(F.col("split") == "train"), features, label, **options)
    test = scoring.score(model, split.filter(F.col("split") == "test"))
    scored = stage(test.select(label, "failure_probability", "prediction"), "test-scores")
    sweep = evaluate.threshold_sweep(scored, "failure_probability", label)
    return Trained(
        model, scored, evaluate.model_metrics(scored, "failure_probability", label), sweep,
        evaluate.select_threshold(sweep))


def write_results(
    folder: str, *, thresholds: DataFrame, importance: DataFrame, highest: DataFrame, predictions: DataFrame,
) -> None:
    """The four result tables of a run: thresholds, importance, the riskiest row, predictions."""
    tables.write_small(thresholds, f"{folder}/threshold_analysis")
    tables.write_small(importance, f"{folder}/feature_importance")
    tables.write_small(highest, f"{folder}/individual_explanation")
    tables.write_processed(
        predictions.select("prediction", "prediction_label", "failure_probability", "risk_level"), f"{folder}/predictions")


def batch_score(
    source: DataFrame, model: str | tuple[PipelineModel, list[str]], table_path: str, batch_id: str,
    created_at: Column | None = None,
) -> predictions.StoredBatch:
    """Check and order the features, coerce, fill 0, score, label, rank the risk, append, verify.

    ``model`` is a path or a loaded model with its features. Every row of the source is
    scored and stored once; the cells that were filled are counted, and the stored batch is
    checked.
    """
    fitted, features = models.load_model(model) if isinstance(model, str) else model
    ready = clean.require_features(source, features)
    gaps = sum((F.when(F.col(f"`{f}`").isNull(), 1).otherwise(0) for f in features), F.lit(0))
    ready = clean.zero_impute(ready.withColumn("__filled", gaps), features)
    keep = [c for c in (S.ROW_KEY, "__filled") if c in ready.columns]
    frame = scoring.prediction_frame(scoring.score(fitted, ready), keep)
    return predictions.store_batch(frame, table_path, batch_id, created_at, "__filled")


@dataclass(frozen=True)
class Explanation:
    explained: DataFrame
    importance: DataFrame
    highest: DataFrame


def explain_model(
    model: PipelineModel, rows: DataFrame, key: str = S.ROW_KEY, n: int | None = S.EXPLAIN_SAMPLE, seed: int = S.SEED,
) -> Explanation:
    """Contributions, ranked importance and the explanation of the riskiest row.

    ``n`` rows are sampled as a report does; None explains every row. Scores and
    contributions are written once; the riskiest row is picked from the scores.
    """
    features = scoring.model_features(model)
    table = explain.tree_table(model)
    taken = rows if n is None else sample.sample_n(rows, n, seed, key)
    scored = stage(scoring.score(model, taken.select(key, *(f"`{f}`" for f in features))), "explain-scored")
    keep = [key, "failure_probability"]
    explained = stage(explain.tree_shap(table, scored, keep), "explained")
    importance = explain.shap_importance_ranked(explained, features)
    riskiest = explain.tree_shap(table, explain.highest_risk_row(scored, key=key), keep)
    return Explanation(explained, importance, explain.explain_row(riskiest, features))
