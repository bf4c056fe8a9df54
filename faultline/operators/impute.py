"""Fitted fills and scalings: exact medians, population z-scores."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.clean import feature_columns
from faultline.sources.tables import stage

_ACCURACY = 10_000
_LARGEST = sys.float_info.max


@dataclass(frozen=True)
class MedianModel:
    medians: Mapping[str, float | None]

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill with the fitted medians; a feature without any value stays missing."""
        known = {c: m for c, m in self.medians.items() if m is not None}
        return df.fillna(known) if known else df


@dataclass(frozen=True)
class ScalerModel:
    means: Mapping[str, float]
    deviations: Mapping[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        def z(c: str) -> Column:
            return ((F.col(f"`{c}`") - F.lit(self.means[c])) / F.lit(self.deviations[c])).alias(c)

        return df.select(*(z(c) if c in self.means else F.col(f"`{c}`") for c in df.columns))


@dataclass
class _Bracket:
    """Closed value range known to hold both middle values of a column."""

    ranks: tuple[int, int]
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0

    def holds(self, c: Column) -> Column:
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c >= F.lit(self.low))
        if self.high is not None:
            test = test & (c <= F.lit(self.high))
        return test

    def shares(self, accuracy: int) -> list[float]:
        """Where to look for the two middle values among those inside.

        A sketch of so few values is exact, so it is asked for the values themselves;
        otherwise for a margin around them.
        """
        first, last = (r - self.below for r in self.ranks)
        if self.inside <= accuracy:
            return [(first - 0.5) / self.inside, (last - 0.5) / self.inside]
        margin = 2.0 / accuracy
        return [max(0.0, first / self.inside - margin), min(1.0, last / self.inside + margin)]


def fit_medians(
    df: DataFrame,
    features: Sequence[str] | None = None,
    counts: Mapping[str, int] | None = None,
    *,
    accuracy: int = _ACCURACY,
) -> MedianModel:
    """Exact median per feature, the mean of the two middle values on even counts.

    ``counts`` are the non-null counts when a profile has them already. A quantile sketch
    brackets the middle, a count pass checks the bracket, and both are repeated inside it
    until the middle values themselves are counted. Columns go together in each pass; what
    a sketch cannot narrow has its value range halved by counts. Nothing is held but
    sketches and counts, whatever the number of rows.
    """
    features = list(features or feature_columns(df))
    if not features:
        return MedianModel({})
    if counts is None:
        row = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(features))).collect()[0]
        counts = {c: row[i] for i, c in enumerate(features)}
    return MedianModel(_narrowed_medians(df, features, counts, accuracy))


def _narrowed_medians(df, features, counts, accuracy) -> dict[str, float | None]:
    done: dict[str, float | None] = {c: None for c in features if counts[c] == 0}
    brackets = {
        c: _Bracket(((counts[c] + 1) // 2, counts[c] // 2 + 1), inside=counts[c])
        for c in features if counts[c]
    }
    stuck: list[str] = []
    while wide := [c for c in brackets if c not in done and c not in stuck]:
        sketch = df.agg(*(
            F.percentile_approx(
                F.when(brackets[c].holds(F.col(f"`{c}`")), F.col(f"`{c}`")),
                brackets[c].shares(accuracy), accuracy,
            ).alias(f"q{i}") for i, c in enumerate(wide)
        )).collect()[0]
        tests = []
        for i, c in enumerate(wide):
            column, (low, high) = F.col(f"`{c}`"), sketch[i]
            tests += [
                F.count_if(column < low).alias(f"b{i}"), F.count_if(column <= low).alias(f"l{i}"),
                F.count_if(column < high).alias(f"h{i}"), F.count_if(column <= high).alias(f"u{i}"),
            ]
        counted = df.agg(*tests).collect()[0]
        for i, c in enumerate(wide):
            bracket, (low, high) = brackets[c], sketch[i]
            below, to_low, before_high, to_high = (counted[f"{x}{i}"] for x in "blhu")
            first, last = bracket.ranks
            if below < first <= to_low and before_high < last <= to_high:
                done[c] = (float(low) + float(high)) / 2
            elif below < first and last <= to_high and to_high - below < bracket.inside:
                bracket.low, bracket.high, bracket.below, bracket.inside = low, high, below, to_high - below
            else:
                stuck.append(c)
    done.update(_medians_by_bisection(df, {c: brackets[c] for c in stuck}))
    return {c: done[c] for c in features}


def _medians_by_bisection(df: DataFrame, brackets: Mapping[str, _Bracket]) -> dict[str, float]:
    """Halve value ranges by counts, all columns and both middle ranks in each pass: always ends."""
    if not brackets:
        return {}
    cells = {c: F.col(f"`{c}`").cast("double") for c in brackets}
    ends = df.agg(*(f(cells[c]).alias(f"{n}{i}") for i, c in enumerate(brackets) for n, f in (("lo", F.min), ("hi", F.max)))).collect()[0]
    ranges = {
        (c, k): [
            float(ends[f"lo{i}"] if b.low is None else b.low), float(ends[f"hi{i}"] if b.high is None else b.high), b.ranks[k]]
        for i, (c, b) in enumerate(brackets.items()) for k in (0, 1)}
    while open_ := [key for key, (low, high, _) in ranges.items() if low < high]:
        tests, middles = [], {}
        for i, key in enumerate(open_):
            low, high, _ = ranges[key]
            middle = max(low, -_LARGEST) / 2 + min(high, _LARGEST) / 2
            middles[key] = middle = low if middle >= high else max(low, middle)
            column = cells[key[0]]
            tests += [
                F.count_if(column <= middle).alias(f"n{i}"), F.max(F.when(column <= middle, column)).alias(f"a{i}"),
                F.min(F.when(column > middle, column)).alias(f"b{i}")]
        row = df.agg(*tests).collect()[0]
        for i, key in enumerate(open_):
            if row[f"n{i}"] >= ranges[key][2]:
                ranges[key][1] = row[f"a{i}"]
            else:
                ranges[key][0] = row[f"b{i}"]
    return {c: (ranges[c, 0][1] + ranges[c, 1][1]) / 2 for c in brackets}


def median_impute(df: DataFrame, features: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Fill with medians of ``fit_on`` (the frame itself unless given).

    The frame that is fitted on is written first: the fit passes over it several times, and
    what made it runs once.
    """
    if fit_on is None:
        df = fit_on = stage(df, "median-rows")
    else:
        fit_on = stage(fit_on.select(*(F.col(f"`{c}`") for c in features or feature_columns(df))), "median-rows")
    return fit_medians(fit_on, features or feature_columns(df)).apply(df)


def fit_scaler(df: DataFrame, features: Sequence[str] | None = None) -> ScalerModel:
    """Mean and population deviation from one aggregate; a constant feature divides by 1."""
    features = list(features or feature_columns(df))
    aggregates = []
    for i, c in enumerate(features):
        column = F.col(f"`{c}`")
        aggregates += [F.avg(column).alias(f"m{i}"), F.stddev_pop(column).alias(f"s{i}")]
    row = df.agg(*aggregates).collect()[0]
    return ScalerModel(
        {c: row[f"m{i}"] for i, c in enumerate(features)},
        {c: row[f"s{i}"] or 1.0 for i, c in enumerate(features)},
    )


def standardize(df: DataFrame, features: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    return fit_scaler(fit_on if fit_on is not None else df, features or feature_columns(df)).apply(df)
