"""Column expressions: text cells to numbers, probabilities to decisions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from faultline import schema as S

# Characters a plain number is made of, or a signed infinity. Spark's own cast would
# also take "NaN", "1d" and "1.5f". Text that passes and still is no number ("--")
# fails the cast; testing first is also faster, a failing cast raises inside the JVM.
NUMBER = r"^([-+0-9.eE]+|[-+]?[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
_PADDED_NUMBER = rf"^\s*{NUMBER[1:-1]}\s*$"
#: What is trimmed: blank, tab, line feed, vertical tab, form feed, carriage return.
_EDGE_SPACE = " \t\n\x0b\x0c\r"


def _col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, tabs included."""
    return F.trim(_col(c), F.lit(_EDGE_SPACE))


def na_to_null(c: Column | str, tokens: Iterable[str] = S.INGEST_NA_TOKENS) -> Column:
    """Null for a cell that is one of the missing-value tokens."""
    c = _col(c)
    return F.when(strip(c).isin(*tokens), None).otherwise(c)


def to_double(c: Column | str) -> Column:
    """Text to double; whatever is not a plain number becomes null, never NaN.

    White space around a number is let through by the pattern and skipped by the cast, which
    costs less than trimming every cell.
    """
    text = _col(c)
    return F.when(text.rlike(_PADDED_NUMBER), text.try_cast("double"))


def to_number(c: Column | str, scale: int | None = 0, tokens: Sequence[str] = S.STRICT_NA_TOKENS) -> Column:
    """Warehouse-style number: trimmed text, the ``na`` token to null, then a safe cast.

    ``scale=0`` rounds fractions away as the warehouse cast does; ``scale=None``
    keeps them as double. The pattern and the cast see to the white space, and a token that
    is no number fails the pattern: each test would make the text of the cell anew.
    """
    text = _col(c).cast("string")
    numbers = [t for t in tokens if re.search(NUMBER, t)]
    if numbers:
        text = strip(text)
        for token in numbers:
            text = F.nullif(text, F.lit(token))
    if scale is None:
        return to_double(text)
    return F.when(text.rlike(_PADDED_NUMBER), text.try_cast(f"decimal(38,{scale})"))


def not_nan(c: Column | str) -> Column:
    """Spark sorts NaN above every number, so a NaN would pass any ``>=``."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def _ladder(value: Column, cutoffs, floor: str) -> Column:
    steps = None
    for name, bound in cutoffs:
        test = value >= F.lit(bound)
        steps = F.when(test, name) if steps is None else steps.when(test, name)
    return steps.otherwise(floor)


def encode_target(c: Column | str = S.CLASS) -> Column:
    c = _col(c)
    return F.when(c == S.NEGATIVE, F.lit(0)).when(c == S.POSITIVE, F.lit(1))


def threshold_label(p: Column | str, threshold: float = S.CLASS_CUTOFF) -> Column:
    """1 where the probability reaches the threshold; a missing one does not."""
    return F.coalesce(not_nan(p) >= F.lit(float(threshold)), F.lit(False)).cast("int")


def prediction_label(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == 0, S.LABELS[0]).when(c == 1, S.LABELS[1])


def risk_level(p: Column | str) -> Column:
    return _ladder(not_nan(p), S.RISK_CUTOFFS, S.RISK_FLOOR)


def maintenance_priority(p: Column | str) -> Column:
    return _ladder(not_nan(p), S.PRIORITY_CUTOFFS, S.PRIORITY_FLOOR)


def recommended_action(priority: Column | str) -> Column:
    priority = _col(priority)
    steps = None
    for name, text in S.ACTIONS.items():
        steps = F.when(priority == name, text) if steps is None else steps.when(priority == name, text)
    return steps.otherwise(S.ACTION_FLOOR)


def format_percent(p: Column | str) -> Column:
    p = _col(p)
    return F.when(p.isNotNull(), F.format_string("%.2f%%", p * 100))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio as double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded share in percent; null where the whole is 0."""
    share = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return F.round(share, digits)


def ordered_rank(c: Column | str, order: Sequence[str]) -> Column:
    """Position of a label in a custom order; unknown labels come last."""
    c = _col(c)
    steps = None
    for place, name in enumerate(order, start=1):
        steps = F.when(c == name, place) if steps is None else steps.when(c == name, place)
    return steps.otherwise(len(order) + 1)


def order_hash(key: Column | str, seed: int = S.SEED) -> Column:
    """Seeded, reproducible stand-in for RANDOM(): md5 of seed and row key, as hex."""
    return F.md5(F.concat(F.lit(str(seed)), _col(key)))


def row_hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row's content.

    xxhash64 passes over nulls, so (null, 1) and (1, null) would collide; the null
    flags are hashed along.
    """
    values = [_col(c) for c in columns]
    flags = [v.isNull() for v in values]
    return tuple(F.xxhash64(F.lit(i), *flags, *values) for i in (1, 2))


def row_fingerprint(columns: Sequence[str]) -> Column:
    """The same 128 bits as hex text, which sorts and takes prefixes."""
    return F.concat(*(F.lpad(F.hex(h), 16, "0") for h in row_hashes(columns)))
