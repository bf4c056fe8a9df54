"""Raw sensors to the processed dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from faultline import schema as S
from faultline.operators import clean, impute, profile
from faultline.sources.tables import stage


@dataclass(frozen=True)
class Processed:
    data: DataFrame
    medians: impute.MedianModel
    dropped_constant: tuple[str, ...]
    dropped_missing: tuple[str, ...]


def preprocess(
    raw: DataFrame,
    limit: float = S.MISSING_SHARE_LIMIT,
    fit_share: DataFrame | None = None,
    staged: bool = True,
) -> Processed:
    """Type, drop constant features, drop high-missing ones, fill medians, encode the class.

    One aggregate profiles every column; both drops and the median plan read it. The
    medians come from all rows unless ``fit_share`` names the training rows. The typed
    columns are written once, so that the later scans read only the kept columns and
    parse no text; ``staged=False`` parses the text again instead. The copy goes with the
    enclosing ``scratch_scope``: write the result inside it.
    """
    typed = clean.to_numeric(raw)
    if staged:
        typed = stage(typed, "typed")
    profiles = profile.collect_profile(typed)
    varied = profile.drop_constant(typed, profiles)
    kept = profile.drop_high_missing(varied, limit, profiles)
    features = clean.feature_columns(kept)
    if fit_share is None:
        counts = {p.column_name: p.non_null for p in profiles}
        medians = impute.fit_medians(kept, features, counts)
    else:
        medians = impute.fit_medians(clean.to_numeric(fit_share).select(*features), features)
    data = clean.encode_target(medians.apply(kept))
    gone = [c for c in typed.columns if c not in varied.columns]
    thin = [c for c in varied.columns if c not in kept.columns]
    return Processed(data, medians, tuple(gone), tuple(thin))
