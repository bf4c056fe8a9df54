"""Class weights, model training, scoring and the prediction frame."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from faultline import schema as S
from faultline.functions import expressions as X
from faultline.operators import boosting, residuals
from faultline.operators.boosting import BoostedTrees
from faultline.operators.clean import feature_columns

WEIGHT = "__weight"
#: Rows of a part in boosted training: at least as many, unless there are fewer, and at most.
PART_ROWS = 20_000, 1_000_000


@dataclass(frozen=True)
class ClassWeights:
    negatives: int
    positives: int

    @property
    def ratio(self) -> float:
        """Negatives per positive."""
        if not self.positives:
            raise ValueError("no positive rows")
        return self.negatives / self.positives

    def scaled(self, label: str = "label") -> Column:
        """The ratio for positives, 1 for negatives."""
        return F.when(F.col(label) == 1, F.lit(self.ratio)).otherwise(F.lit(1.0))

    def balanced(self, label: str = "label") -> Column:
        """n / (2 * rows of the class)."""
        n = self.negatives + self.positives
        return F.when(F.col(label) == 1, F.lit(n / (2 * self.positives))).otherwise(F.lit(n / (2 * self.negatives)))


@dataclass(frozen=True)
class BoostParams:
    """Boosted-tree settings; the defaults are the reference values MLlib can express."""

    rounds: int = 300
    depth: int = 5
    step: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_rows: int = 1
    bins: int = 256
    seed: int = S.SEED


WEIGHTED_BOOST = BoostParams(min_rows=3)


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    return df.agg(F.count_if(y == 0).alias("negatives"), F.count_if(y == 1).alias("positives"))


def fit_class_weights(df: DataFrame, label: str = "label") -> ClassWeights:
    return ClassWeights(*_class_counts(df, label).collect()[0])


def scale_pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    counts = _class_counts(df, label)
    ratio = F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double"))
    return counts.select("negatives", "positives", ratio.alias("scale_pos_weight"))


def balanced_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and weight per class; a class without rows has no weight."""
    counts = _class_counts(df, label)
    n = (F.col("negatives") + F.col("positives")).cast("double")

    def entry(value: int, name: str):
        weight = F.try_divide(n, 2 * F.col(name).cast("double"))
        return F.struct(
            F.lit(value).alias("label"), F.col(name).alias("row_count"), weight.alias("class_weight"))

    return counts.select(F.inline(F.array(entry(0, "negatives"), entry(1, "positives"))))


def split_features_target(
    df: DataFrame, features: Sequence[str] | None = None, label: str = S.CLASS, keep: Sequence[str] = (),
) -> DataFrame:
    """``features`` vector and double ``label``."""
    assembler = VectorAssembler(inputCols=list(features or feature_columns(df, (label, "split"))), outputCol="features")
    return assembler.transform(df).select(*keep, "features", F.col(label).cast("double").alias("label"))


def _fit(df: DataFrame, features: Sequence[str], label: str, weight: Column | None, *stages) -> PipelineModel:
    """Fit on the narrow columns only.

    The estimators keep their own blocks of the rows between rounds, so nothing is
    cached here; rows that are costly to compute should come from a written stage.
    """
    columns = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    columns.append(F.col(label).cast("double").alias("label"))
    if weight is not None:
        columns.append(weight.alias(WEIGHT))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, *stages]).fit(df.select(*columns))


def train_logreg(
    df: DataFrame, features: Sequence[str], label: str = "label", balanced: bool = False, iterations: int = 2000,
    tolerance: float = 1e-9,
) -> PipelineModel:
    """Standardise, then L2 logistic regression of strength C = 1.

    The scaler stage divides by the sample deviation. Dividing by the population one
    would stretch every feature by sqrt(n / (n - 1)); the penalty is scaled by
    (n - 1) / n instead, which gives the same model.
    """
    weights = fit_class_weights(df, label)
    n = weights.negatives + weights.positives
    if min(weights.negatives, weights.positives) == 0:
        raise ValueError("training rows hold one class only")

    scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled")
    regression = LogisticRegression(
        featuresCol="scaled", labelCol="label", regParam=(n - 1) / n / n, elasticNetParam=0.0,
        standardization=False, maxIter=iterations, tol=tolerance, family="binomial")
    if balanced:
        regression.setWeightCol(WEIGHT)
    return _fit(df, features, label, weights.balanced(label) if balanced else None, scaler, regression)


def train_logreg_balanced(df: DataFrame, features: Sequence[str], label: str = "label", **options) -> PipelineModel:
    return train_logreg(df, features, label, balanced=True, **options)


def _dealt(df: DataFrame) -> DataFrame:
    """The rows in even parts, as many as there are cores or some for each.

    Every round passes over all parts; files read in splits may leave a part of the cores without rows.
    """
    fewest, most = PART_ROWS
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores * max(1, math.ceil(n / most / cores)), n // fewest)))


def train_boosted(
    df: DataFrame, features: Sequence[str], label: str = "label", params: BoostParams = BoostParams(), weighted: bool = False,
) -> PipelineModel:
    """MLlib's gradient-boosted trees, grown by tasks that keep their rows (``residuals.py``)."""
    weight = fit_class_weights(df, label).scaled(label) if weighted else None
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=params.rounds, maxDepth=params.depth, stepSize=params.step,
        subsamplingRate=params.row_share, featureSubsetStrategy=str(params.feature_share),
        minInstancesPerNode=params.min_rows, maxBins=params.bins, seed=params.seed, checkpointInterval=10)
    if weighted:
        trees.setWeightCol(WEIGHT)
    objective = residuals.Residuals(
        params.rounds, params.depth, params.step, params.row_share, params.feature_share, params.min_rows, params.bins, params.seed,
        weighted)
    # Equal rows are drawn apart, as the library does.
    grown, _ = boosting.grown(
        df, features, label, objective, weight, F.xxhash64(F.monotonically_increasing_id()), midpoints=True, one_class=True)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return PipelineModel([assembler, residuals.as_mllib(df.sparkSession, trees, grown, len(features))])


def train_boosted_weighted(
    df: DataFrame, features: Sequence[str], label: str = "label", params: BoostParams = WEIGHTED_BOOST,
) -> PipelineModel:
    return train_boosted(df, features, label, params, weighted=True)


def train_second_order(
    df: DataFrame, features: Sequence[str], label: str = "label", params: boosting.Params = boosting.Params(), weighted: bool = False,
    key: str | None = None,
) -> BoostedTrees:
    """Boosted trees on gradient and hessian sums, with every penalty of the reference's settings."""
    weight = fit_class_weights(df, label).scaled(label) if weighted else None
    return boosting.fit(df, features, label, params, weight, key)


def train_second_order_weighted(
    df: DataFrame, features: Sequence[str], label: str = "label", params: boosting.Params = boosting.WEIGHTED, key: str | None = None,
) -> BoostedTrees:
    return train_second_order(df, features, label, params, weighted=True, key=key)


def model_features(model: PipelineModel | BoostedTrees) -> list[str]:
    """Feature order of a fitted model, read from its assembler."""
    if isinstance(model, BoostedTrees):
        return list(model.features)
    for stage in getattr(model, "stages", []):
        if isinstance(stage, VectorAssembler):
            return stage.getInputCols()
    raise ValueError("the model has no feature order: no VectorAssembler among its stages")


def score(model: PipelineModel | BoostedTrees, df: DataFrame, threshold: float = S.CLASS_CUTOFF) -> DataFrame:
    """Input columns plus ``failure_probability`` and the class ``prediction``."""
    if isinstance(model, BoostedTrees):
        kept = [F.col(f"`{c}`") for c in df.columns if c not in ("prediction", "failure_probability")]
        return df.select(*kept, model.probability().alias("failure_probability")).withColumn(
            "prediction", X.threshold_label("failure_probability", threshold))
    inner = ("features", "scaled", "rawPrediction", "probability", "prediction")
    clash = [c for c in inner if c in df.columns]
    scored = model.transform(df.drop(*clash))
    probability = vector_to_array("probability")[1]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (*inner, "failure_probability")]
    return scored.select(*kept, probability.alias("failure_probability")).withColumn(
        "prediction", X.threshold_label("failure_probability", threshold))


def score_proba(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return score(model, df).select(*keep, "failure_probability")


def score_class(model: PipelineModel, df: DataFrame, keep: Sequence[str] = (), threshold: float = S.CLASS_CUTOFF) -> DataFrame:
    return score(model, df, threshold).select(*keep, "prediction")


def prediction_frame(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prediction, its label, the probability and the risk level."""
    return scored.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        X.prediction_label("prediction").alias("prediction_label"),
        F.col("failure_probability").cast("double").alias("failure_probability"),
        X.risk_level("failure_probability").alias("risk_level"),
    )
