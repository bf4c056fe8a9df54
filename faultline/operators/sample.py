"""Exact, reproducible row samples: balance, per-class splits, n rows.

A row's place in the random order is a seeded md5 of its key, then a fingerprint of its
content. Keeping the first k rows of a class needs no sort of that class: counts per prefix
of the order find the prefix at which rank k falls, a few digits deeper each time, and the
split is then a plain filter. Rows that are equal in every column share their place; they
are interchangeable, so only their number matters.

The input is read twice: once its key and class alone, whose places are written, and once
whole, by the split. All counting is done on the written places. Only where rows of equal
keys stand on both sides of a cutoff is their content read as well.

The cutoffs are a table with a row per class, joined to the data by class: one way for any
number of rows and classes, and the result does not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import schema as S
from faultline.functions import expressions as X
from faultline.sources.tables import stage

_DIGITS = 3            # hex digits per level: at most 4,096 counts per class
_HASH_DIGITS = 32
_CHUNK = 1_000_000     # equal rows that one task makes anew
_RANK_ROWS = 100_000   # ranked rows per class and prefix, about

Quota = Callable[[DataFrame], DataFrame]


def _place(seed: int, key: str) -> Column:
    """A row's place by its key: 32 hex digits."""
    return F.rpad(F.coalesce(X.order_hash(key, seed), F.lit("")), _HASH_DIGITS, "0")


def _order(df: DataFrame, seed: int, key: str, prefix: Column) -> Column:
    """As many digits of a row's place as ``prefix`` has; the content enters only where the hash is equal."""
    place = _place(seed, key)
    deeper = (F.length(prefix) > _HASH_DIGITS) & (place == F.substring(prefix, 1, _HASH_DIGITS))
    return F.when(deeper, F.concat(place, X.row_fingerprint(df.columns))).otherwise(place)


def totals(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(F.col(by).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def first_k(k: int) -> Quota:
    """The same number of rows from every class."""
    return lambda counts: counts.withColumn("wanted", F.lit(k).cast("bigint"))


def stratified(test_share: float = S.TEST_SHARE) -> Quota:
    """Training rows per class: shares kept, rounding by largest remainder."""
    def quota(counts: DataFrame) -> DataFrame:
        n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
        train = n - math.ceil(n * test_share - 1e-9)
        exact = F.lit(train) * F.col("n") / F.lit(max(1, n))
        shares = counts.select("by", "n", F.floor(exact).alias("wanted"), (exact - F.floor(exact)).alias("rest"))
        left = train - shares.agg(F.coalesce(F.sum("wanted"), F.lit(0))).collect()[0][0]
        more = shares.orderBy(F.desc("rest"), F.col("by").cast("string")).limit(int(left)).select(
            F.col("by").alias("b"), F.lit(1).alias("more"))
        return shares.join(more, F.col("by").eqNullSafe(F.col("b")), "left").select(
            "by", "n", (F.col("wanted") + F.coalesce("more", F.lit(0))).alias("wanted"))

    return quota


def balanced(k: int) -> Quota:
    """All positives, k negatives, nothing else."""
    def quota(counts: DataFrame) -> DataFrame:
        return counts.withColumn(
            "wanted", F.when(F.col("by") == S.POSITIVE, F.col("n")).when(F.col("by") == S.NEGATIVE, F.lit(k)).otherwise(F.lit(0)))

    return quota


def cutoffs(df: DataFrame, by: str, quota: Quota, seed: int = S.SEED, key: str = S.ROW_KEY) -> DataFrame:
    """Per class where its first rows end: (by, at, wanted, n).

    Rows whose place begins below ``at`` are first rows, and of the ``n`` rows that begin
    with it the first ``wanted``: all of them, unless they are equal rows.
    """
    places = stage(df.select(F.col(by).alias("by"), F.unhex(_place(seed, key)).alias("place")), "sample-places")
    places = places.withColumn("place", F.lower(F.hex("place")))
    wanted = stage(quota(totals(places, "by")).select("by", "n", F.col("wanted").cast("bigint").alias("wanted")), "sample-quota")
    inside = (F.col("wanted") > 0) & (F.col("wanted") < F.col("n"))
    # "" is a prefix of every place: all rows of the class begin with it.
    clamped = F.least(F.greatest("wanted", F.lit(0)), F.col("n"))
    done = [wanted.where(~inside).select("by", F.lit("").alias("at"), clamped.alias("wanted"), "n")]
    pending = wanted.where(inside).select("by", F.lit("").alias("at"), "wanted")
    while not pending.isEmpty():
        found = _deeper(places, pending.where(F.length("at") < _HASH_DIGITS))
        tied = pending.where(F.length("at") >= _HASH_DIGITS)
        if not tied.isEmpty():
            found = found.unionByName(_deeper(_tied(df, by, tied, seed, key), tied))
        found = stage(found, "sample-cutoffs")
        closed = (F.col("wanted") == F.col("n")) | (F.length("at") >= 2 * _HASH_DIGITS)
        done.append(found.where(closed).select("by", "at", "wanted", "n"))
        pending = found.where(~closed).select("by", "at", "wanted")
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return stage(out, "sample-cutoffs")


def _tied(df: DataFrame, by: str, pending: DataFrame, seed: int, key: str) -> DataFrame:
    """The rows whose keys stand at a cutoff, with their content behind the place."""
    at = pending.select(F.col("by").alias("__b"), F.col("at").alias("__at"))
    rows = df.select("*", F.col(by).alias("__by")).join(
        at, F.col("__by").eqNullSafe(F.col("__b")) & (_place(seed, key) == F.substring("__at", 1, _HASH_DIGITS)))
    return rows.select(F.col("__b").alias("by"), F.concat(_place(seed, key), X.row_fingerprint(df.columns)).alias("place"))


def _prefix_counts(places: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows per pending class and longer prefix, and the least and greatest hash of their places.

    All of fixed width, so rows merge by hash; the least text of a group would be found by sorting all rows.
    """
    pending = pending.select(F.col("by").alias("__b"), "at", "wanted")
    rows = places.join(pending, F.col("by").eqNullSafe(F.col("__b")) & F.col("place").startswith(F.col("at")))
    return rows.groupBy(F.col("__b").alias("by"), "at", "wanted", F.expr(f"left(place, length(at) + {_DIGITS})").alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("place")).alias("lo"), F.max(F.xxhash64("place")).alias("hi"))


def _deeper(places: DataFrame, pending: DataFrame) -> DataFrame:
    """Per pending class the longer prefix that holds its rank: (by, at, wanted, n)."""
    counts = _prefix_counts(places, pending)
    upto = W.partitionBy("by").orderBy("prefix")
    ranked = counts.withColumn("upto", F.sum("n").over(upto))
    hit = ranked.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
    found = stage(hit.select(
        "by", "prefix", (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted"), "n", (F.col("lo") == F.col("hi")).alias("one")), "sample-prefixes")
    # Where all rows share one place the steps in between are skipped.
    one = found.where(F.col("one") & (F.col("n") > 1)).select(F.col("by").alias("__b"), "prefix")
    if one.isEmpty():
        return found.select("by", F.col("prefix").alias("at"), "wanted", "n")
    same = places.join(one, F.col("by").eqNullSafe(F.col("__b")) & F.col("place").startswith(F.col("prefix"))).groupBy("__b", "place").agg(
        F.count(F.lit(1)).alias("__m"))
    both = found.join(same, F.col("by").eqNullSafe(F.col("__b")) & (F.col("n") == F.col("__m")), "left")
    return both.select("by", F.coalesce("place", "prefix").alias("at"), "wanted", "n")


def _copied(rows: DataFrame, count: str, index: str) -> DataFrame:
    """Each row as often as ``count`` says, with ``index`` 0, 1 ...; spread over tasks in chunks."""
    chunks = rows.withColumn("__chunk", F.explode(F.expr(f"sequence(0, ({count} - 1) div {_CHUNK})")))
    chunks = chunks.repartition(F.col("__chunk"))
    size = f"least({_CHUNK}, {count} - __chunk * {_CHUNK})"
    return chunks.withColumn("__place", F.explode(F.expr(f"sequence(0, {size} - 1)"))).withColumn(
        index, F.expr(f"__chunk * {_CHUNK} + __place")).drop("__chunk", "__place")


def _flagged(df: DataFrame, by: str, cuts: DataFrame, seed: int, key: str, out: str) -> DataFrame:
    """Every row with a flag: whether it is one of the first rows of its class."""
    at, wanted = F.col("__at"), F.col("__wanted")
    marked = df.join(
        cuts.select(F.col("by").alias("__by"), F.col("at").alias("__at"), F.col("wanted").alias("__wanted"), F.col("n").alias("__total")),
        F.col(by).eqNullSafe(F.col("__by")))
    begin = F.expr("left(__order, length(__at))")
    flag = (
        F.when(wanted == 0, begin < at).when(wanted == F.col("__total"), begin <= at).when(begin != at, begin < at))
    names = [F.col(f"`{c}`") for c in df.columns]
    flagged = marked.withColumn("__order", _order(df, seed, key, at)).select(*names, flag.alias(out), "__wanted")
    split = cuts.where((F.col("wanted") > 0) & (F.col("wanted") < F.col("n")))
    if split.isEmpty():
        return flagged.select(*names, out)
    # Equal rows on both sides of a cutoff: made anew, the right number on each side.
    equal = flagged.where(F.col(out).isNull()).drop(out).groupBy(*names, "__wanted").agg(F.count(F.lit(1)).alias("__n"))
    equal = _copied(equal, "__n", "__i").select(*names, (F.col("__i") < wanted).alias(out))
    return flagged.where(F.col(out).isNotNull()).select(*names, out).unionByName(equal)


def _first(df: DataFrame, by: str, quota: Quota, seed: int, key: str) -> DataFrame:
    cuts = cutoffs(df, by, quota, seed, key)
    return _flagged(df, by, cuts, seed, key, "__first").filter("__first").drop("__first")


def first_per_class(
    df: DataFrame, k: int, by: str = S.CLASS, seed: int = S.SEED, key: str = S.ROW_KEY,
) -> DataFrame:
    """The first k rows of each class in the seeded order."""
    return _first(df, by, first_k(k), seed, key)


def row_number_per_class(
    df: DataFrame, k: int, by: str = S.CLASS, seed: int = S.SEED, key: str = S.ROW_KEY, name: str = "row_number",
) -> DataFrame:
    """Rank within the class for the first k rows.

    Ranks run inside (class, prefix of the place); a sum per prefix gives each its offset.
    Equal rows enter once with their number.
    """
    digits = max(1, math.ceil(math.log(max(1, k / _RANK_ROWS), 16)))
    first = first_per_class(df, k, by, seed, key)
    names = [F.col(f"`{c}`") for c in df.columns]
    rows = first.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    rows = stage(rows.withColumn("__order", _order(df, seed, key, F.lit("~" * (_HASH_DIGITS + 1)))).withColumn(
        "__full", F.concat("__order", X.row_fingerprint(df.columns))).withColumn(
        "__prefix", F.substring("__full", 1, digits)), "ranked-rows")
    before = W.partitionBy("__by").orderBy("__prefix").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(by).alias("__by"), "__prefix").agg(F.sum("__n").alias("__sum"))
    offsets = sums.select("__by", F.col("__prefix").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(by, "__prefix").orderBy("__full").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    ranked = ranked.join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__prefix") == F.col("__p")))
    return _copied(ranked, "__n", "__i").select(
        *names, (F.col("__offset") + F.col("__before") + F.col("__i") + 1).cast("bigint").alias(name))


def split_at(
    df: DataFrame, quota: Quota, by: str = S.CLASS, seed: int = S.SEED, key: str = S.ROW_KEY,
) -> DataFrame:
    """Add ``split``: ``train`` for the first rows of each class, ``test`` for the rest."""
    cuts = cutoffs(df, by, quota, seed, key)
    side = F.when(F.col("__first"), "train").otherwise("test").alias("split")
    return _flagged(df, by, cuts, seed, key, "__first").select(*(f"`{c}`" for c in df.columns), side)


def split_per_class(
    df: DataFrame, k: int = S.TRAIN_ROWS_PER_CLASS, by: str = S.CLASS, seed: int = S.SEED, key: str = S.ROW_KEY,
) -> DataFrame:
    """One rank, two disjoint sides: the first k rows of each class train, the others test."""
    return split_at(df, first_k(k), by, seed, key)


def train_split_per_class(df: DataFrame, k: int = S.TRAIN_ROWS_PER_CLASS, **options) -> DataFrame:
    return split_per_class(df, k, **options).filter(F.col("split") == "train").drop("split")


def test_split_per_class(df: DataFrame, k: int = S.TRAIN_ROWS_PER_CLASS, **options) -> DataFrame:
    return split_per_class(df, k, **options).filter(F.col("split") == "test").drop("split")


def exact_stratified_split(
    df: DataFrame, test_share: float = S.TEST_SHARE, by: str = S.CLASS, seed: int = S.SEED, key: str = S.ROW_KEY,
) -> DataFrame:
    """Shares of every class kept exactly in both sides."""
    return split_at(df, stratified(test_share), by, seed, key)


def sample_n(df: DataFrame, n: int = S.EXPLAIN_SAMPLE, seed: int = S.SEED, key: str = S.ROW_KEY) -> DataFrame:
    """min(n, rows) rows without replacement: the first n of one class that holds all rows."""
    whole = df.withColumn("__all", F.lit("all"))
    return first_per_class(whole, n, "__all", seed, key).drop("__all")


def balance_classes(
    df: DataFrame, k: int = S.BALANCE_NEGATIVES, by: str = S.CLASS, seed: int = S.SEED, key: str = S.ROW_KEY,
) -> DataFrame:
    """All positives and k random negatives; fewer than k negatives are all kept."""
    return _first(df, by, balanced(k), seed, key)
