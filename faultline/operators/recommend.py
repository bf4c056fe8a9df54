"""Prescriptive recommendations: which action for which machine, under one budget.

Each machine may take one of its options (cost, benefit) or none. At a price per unit of cost a
machine takes the option with the largest benefit less cost times price, if that is above 0; the
lower the price, the more is spent. The one price at which the budget is just kept is found by
searching merged histograms of the prices at which machines change their choice, never by
sorting machines. At that price the machines that are about to change share what is left of the
budget, by an order of their own hash, as far as whole changes fit.

The changes of a machine are the edges of the concave hull of its options, so their prices fall
with the cost: a choice is a prefix of them. A budget is never exceeded, and what the result
falls short of the best one is less than the benefit of one change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from faultline.sources.tables import stage

_BINS = 4_096
_CHANGES = "machine string, step int, action string, cost double, benefit double, price double"


def _hull(options: list[tuple[float, float, str]]) -> list[tuple[float, float, str]]:
    """Options on the concave hull over no action, by cost: each adds less per cost than the one before."""
    out = [(0.0, 0.0, "")]
    for cost, benefit, action in sorted(options, key=lambda o: (o[0], -o[1], o[2])):
        if benefit <= out[-1][1]:
            continue
        while len(out) > 1 and (benefit - out[-2][1]) * (out[-1][0] - out[-2][0]) >= (out[-1][1] - out[-2][1]) * (cost - out[-2][0]):
            out.pop()
        out.append((cost, benefit, action))
    return out


def changes(options: DataFrame) -> DataFrame:
    """Of options (machine, action, cost, benefit) each machine's changes: added cost and benefit, and their ratio as price.

    Null machines, and options whose cost or benefit is null, not a number or not above 0, are
    left out. A machine's options are one small group: repeated ones merge before the shuffle.
    """
    cost, benefit = (F.col(c).cast("double") for c in ("cost", "benefit"))
    usable = F.col("machine").isNotNull() & (cost > 0) & (benefit > 0) & ~F.isnan(cost) & ~F.isnan(benefit)
    rows = options.where(usable).groupBy(F.col("machine").cast("string").alias("machine"), F.col("action").cast("string").alias("action"), cost.alias("cost")).agg(
        F.max(benefit).alias("benefit"))
    listed = rows.groupBy("machine").agg(F.collect_list(F.struct("cost", "benefit", F.coalesce("action", F.lit("")).alias("action"))).alias("options"))

    def hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for machine, own in zip(batch["machine"], batch["options"]):
                hull = _hull([(o["cost"], o["benefit"], o["action"]) for o in own])
                out += [
                    (machine, k, b[2], b[0] - a[0], b[1] - a[1], (b[1] - a[1]) / (b[0] - a[0]))
                    for k, (a, b) in enumerate(zip(hull, hull[1:]), 1)]
            yield pd.DataFrame(out, columns=["machine", "step", "action", "cost", "benefit", "price"])

    return stage(listed.mapInPandas(hulls, _CHANGES), "recommended-changes")


def price(found: DataFrame, budget: float) -> tuple[float, float]:
    """The highest price whose takers, all changes at or above it, cost more than the budget, and the cost of those above it.

    Price 0 if the budget covers everything. Each pass cuts the range of prices into bins, adds
    up costs per bin and keeps the bin that holds the price, until it holds one price only.
    """
    low, high, above = found.agg(F.coalesce(F.min("price"), F.lit(0.0)), F.coalesce(F.max("price"), F.lit(0.0)), F.coalesce(F.sum("cost"), F.lit(0.0))).first()
    if above <= budget:
        return 0.0, float(above)
    spent = 0.0
    while low < high:
        width = (high - low) / _BINS
        bin_ = F.least(F.floor((F.col("price") - low) / width), F.lit(_BINS - 1)) if width > 0 else F.lit(0)
        sums = found.where(F.col("price").between(low, high)).groupBy(bin_.alias("bin")).agg(
            F.sum("cost").alias("cost"), F.min("price").alias("low"), F.max("price").alias("high")).orderBy(F.desc("bin")).collect()
        for row in sums:
            if spent + row["cost"] > budget:
                low, high = row["low"], row["high"]
                break
            spent += row["cost"]
        else:
            return float(low), spent
    return float(low), spent


def recommended(options: DataFrame, budget: float) -> DataFrame:
    """One row per machine that acts: machine, action, cost, benefit (of the chosen option)."""
    found = changes(options)
    at, spent = price(found, budget)
    tied = found.where(F.col("price") == at)
    # Whole changes in the order of a hash, as long as their running cost fits: a sum per bucket of the
    # hash, then inside the bucket where the rest of the budget ends.
    hashed = tied.select("machine", "step", "cost", F.xxhash64("machine", "step").alias("h"), F.shiftrightunsigned(F.xxhash64("machine", "step"), 52).alias("bucket"))
    upto = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    buckets = hashed.groupBy(F.col("bucket").alias("b")).agg(F.sum("cost").alias("sum"))
    buckets = buckets.select("b", F.coalesce(F.sum("sum").over(upto), F.lit(0.0)).alias("before"))
    inside = W.partitionBy("bucket").orderBy("h", "machine")
    running = hashed.join(buckets, F.col("bucket") == F.col("b")).withColumn("running", F.col("before") + F.sum("cost").over(inside))
    fits = running.where(F.col("running") + spent <= budget).select("machine", "step", F.lit(True).alias("fits"))
    taken = found.where(F.col("price") > at) if at > 0 else found
    if at > 0:
        taken = taken.unionByName(tied.join(fits.drop("fits"), ["machine", "step"], "left_semi"))
    return taken.groupBy("machine").agg(
        F.max_by("action", "step").alias("action"), F.sum("cost").alias("cost"), F.sum("benefit").alias("benefit"))
