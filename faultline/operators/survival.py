"""Remaining useful life from failure events: right-censored episodes, product-limit survival, residual life.

An episode of a unit runs from one failure (or its first event) to the next; the last one is
censored at the end of observation. Durations are whole periods, so a group has at most as many
distinct ones as the horizon has periods, whatever the rows: counts by (group, duration) merge
before the shuffle, and everything after them is running sums over that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def episodes(events: DataFrame, failed: Column, until: Column, unit: str = "unit", time: str = "at", period_seconds: int = 3600) -> DataFrame:
    """One row per episode: unit, started_at, duration (whole periods), failed.

    Failures of a unit at one time are one; events without unit or time, and those after ``until``,
    are left out. The failure before is sought inside (unit, day) and then among the days, a row
    each, so no unit is sorted as a whole. An episode of length zero is one of duration 0.
    """
    rows = events.select(F.col(unit).alias("unit"), F.col(time).cast("timestamp").alias("at"), failed.alias("failed"))
    end = until.cast("timestamp")
    rows = rows.where(F.col("unit").isNotNull() & F.col("at").isNotNull() & (F.col("at") <= end))
    spans = rows.groupBy("unit").agg(F.min("at").alias("first"), F.max(F.when(F.col("failed"), F.col("at"))).alias("last"))
    failures = rows.where("failed").select("unit", "at", F.to_date("at").alias("day")).distinct()
    days = failures.groupBy("unit", "day").agg(F.max("at").alias("latest"))
    before = W.partitionBy("unit").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(F.col("unit").alias("u"), F.col("day").alias("d"), F.max("latest").over(before).alias("carried"))
    inside = W.partitionBy("unit", "day").orderBy("at")
    known = failures.join(days, (F.col("unit") == F.col("u")) & (F.col("day") == F.col("d"))).select(
        "unit", "at", F.coalesce(F.lag("at").over(inside), F.col("carried")).alias("earlier"))
    ended = known.join(spans.select(F.col("unit").alias("u"), "first"), F.col("unit") == F.col("u")).select(
        "unit", F.coalesce("earlier", "first").alias("started_at"), F.col("at").alias("ended_at"), F.lit(True).alias("failed"))
    running = spans.select("unit", F.coalesce("last", "first").alias("started_at"), end.alias("ended_at"), F.lit(False).alias("failed"))
    both = ended.unionByName(running)
    seconds = F.col("ended_at").cast("double") - F.col("started_at").cast("double")
    return both.select("unit", "started_at", F.floor(seconds / period_seconds).cast("bigint").alias("duration"), "failed")


def survival_curve(rows: DataFrame, by: Sequence[str] = (), duration: str = "duration", failed: str = "failed") -> DataFrame:
    """Per group and duration: at_risk, failures, censored, hazard, survival (product limit, after that duration).

    Censored rows of a duration are at risk at it. A group without failures has survival 1
    throughout; null or negative durations and null flags are left out.
    """
    by = list(by)
    usable = F.col(duration).isNotNull() & (F.col(duration) >= 0) & F.col(failed).isNotNull()
    counts = rows.where(usable).groupBy(*by, F.col(duration).alias("duration")).agg(
        F.count_if(F.col(failed)).alias("failures"), F.count_if(~F.col(failed)).alias("censored"))
    later = W.partitionBy(*by).orderBy(F.desc("duration"))
    counts = counts.withColumn("at_risk", F.sum(F.col("failures") + F.col("censored")).over(later))
    counts = counts.withColumn("hazard", F.col("failures") / F.col("at_risk"))
    upto = W.partitionBy(*by).orderBy("duration")
    over = F.max((F.col("failures") == F.col("at_risk")).cast("int")).over(upto) == 1
    logs = F.sum(F.when(F.col("failures") < F.col("at_risk"), F.log1p(-F.col("hazard"))).otherwise(0.0)).over(upto)
    return counts.select(
        *by, "duration", "at_risk", "failures", "censored", "hazard", F.when(over, 0.0).otherwise(F.exp(logs)).alias("survival"))


def remaining_life(units: DataFrame, curve: DataFrame, by: Sequence[str] = (), age: str = "age", share: float = 0.5) -> DataFrame:
    """Add to units: survival_share (of those that reached the age), median_left (periods until ``share`` of them have failed).

    ``median_left`` is null where the curve does not fall that far, and both are null for ages
    that nobody outlived and groups without a curve. A group's curve travels as one array, as
    long as it has durations.
    """
    by = list(by)
    keys = [F.col(c).alias(f"__{c}") for c in by]
    arrays = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("duration", "survival"))).alias("__curve"))
    # The answer goes by group and age: each pair is looked up once, whatever the units.
    asked = units.where(F.col(age).isNotNull()).select(*keys, F.col(age).alias("__age")).distinct()
    asked = asked.withColumnsRenamed({f"__{c}": f"__of_{c}" for c in by})

    def same(side: str, other: str) -> Column:
        test = F.lit(True)
        for c in by:
            test = test & F.col(f"{side}{c}").eqNullSafe(F.col(f"{other}{c}"))
        return test

    a = F.col("__age")
    last = F.try_element_at(F.col("__curve"), F.lit(-1))["survival"]
    lasting = F.filter("__curve", lambda p: p["duration"] < a)
    reached = F.coalesce(F.try_element_at(lasting, F.lit(-1))["survival"], F.lit(1.0))
    # One step after the other: inside a lambda ``reached`` would be sought for every element.
    found = asked.join(arrays, same("__of_", "__")).select(
        *(f"__of_{c}" for c in by), "__age", last.alias("__last"), F.filter("__curve", lambda p: p["duration"] >= a).alias("__later"),
        F.explode(F.array(reached)).alias("__reached"))
    # A survival that is just the share may miss it by the rounding of its logarithms.
    limit = F.col("__reached") * (1 - share) + 1e-12
    fallen = F.filter("__later", lambda p: p["survival"] <= limit)
    answers = found.where(F.col("__reached") > 0).select(
        *(f"__of_{c}" for c in by), "__age", (F.col("__last") / F.col("__reached")).alias("__share"),
        (F.get(fallen, F.lit(0))["duration"] - a).cast("bigint").alias("__left"))
    test = F.col(age).eqNullSafe(F.col("__age"))
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return units.join(answers, test, "left").select(
        *(F.col(f"`{c}`") for c in units.columns), F.col("__share").alias("survival_share"), F.col("__left").alias("median_left"))
