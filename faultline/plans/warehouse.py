"""The warehouse route: staging copy to balanced, split model tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from faultline import schema as S
from faultline.operators import clean, sample
from faultline.sources.tables import stage


def final_features(raw: DataFrame, scale: int | None = 0, excluded: Sequence[str] = S.EXCLUDED_FEATURES) -> DataFrame:
    """Strictly typed, without the excluded features, missing cells as 0.

    The intermediate copies of the route are stages of one projection here.
    """
    return clean.zero_impute(clean.exclude_columns(clean.clean_numeric_strict(raw, scale), excluded))


def model_tables(
    raw: DataFrame,
    features: Sequence[str] = S.TOP_FEATURES,
    negatives: int = S.BALANCE_NEGATIVES,
    train_rows: int = S.TRAIN_ROWS_PER_CLASS,
    scale: int | None = 0,
    seed: int = S.SEED,
) -> DataFrame:
    """Balanced rows with the model features and a ``split`` of train or test.

    Cleaning works row by row, so the rows are chosen first and only the chosen ones
    are cleaned; the balanced table is written, as the route does, and split from
    there. One seeded rank feeds both sides, so they never share a row.
    """
    balanced = final_features(sample.balance_classes(raw, negatives, seed=seed), scale)
    top = stage(clean.select_top_features(balanced, features, keep=(S.ROW_KEY, S.CLASS)), "balanced")
    # Another seed than the balance: its order would put the balance's first rows in train.
    return sample.split_per_class(top, train_rows, seed=seed + 1)
