"""Survival against the product over risk sets, and episodes against a walk over each unit."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import survival

DAY = datetime.datetime(2024, 5, 1)
END = DAY + datetime.timedelta(days=20)


def _plain_curve(rows):
    out, left = [], 1.0
    for t in sorted({d for d, _ in rows}):
        risk = sum(d >= t for d, _ in rows)
        died = sum(d == t and f for d, f in rows)
        left *= 1 - died / risk
        out.append((t, risk, died, sum(d == t and not f for d, f in rows), pytest.approx(died / risk), pytest.approx(left)))
    return out


def test_curves_of_groups(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.randrange(30), draw.random() < 0.6) for _ in range(400)]
    rows += [("all", 3, True)] * 5 + [("all", 5, True)] * 2 + [("none", k, False) for k in range(6)] + [(None, 2, True), (None, 4, False)]
    odd = [("a", None, True), ("a", -1, True), ("a", 3, None)]
    df = spark.createDataFrame(rows + odd, "g string, duration bigint, failed boolean").repartition(3)
    got = {}
    for r in survival.survival_curve(df, ["g"]).orderBy("duration").collect():
        got.setdefault(r["g"], []).append(tuple(r)[1:])
    for g in ("a", "b", "all", "none", None):
        assert got[g] == _plain_curve([(d, f) for k, d, f in rows if k == g])
    assert got["all"][-1][-1] == 0 and {r[-1] for r in got["none"]} == {1.0}
    whole = [tuple(r) for r in survival.survival_curve(df).orderBy("duration").collect()]
    assert whole == _plain_curve([(d, f) for _, d, f in rows])
    assert survival.survival_curve(df.where("false"), ["g"]).count() == 0


def test_episodes(spark):
    draw = random.Random(5)
    rows = []
    for u in range(8):
        at = DAY + datetime.timedelta(hours=u)
        for _ in range(60):
            at += datetime.timedelta(minutes=draw.choice([0, 30, 200, 900]))
            rows.append((f"u{u}", at, draw.random() < 0.3))
    rows += [("quiet", DAY, False), ("once", DAY, True), (None, DAY, True), ("u0", None, True), ("u0", END + datetime.timedelta(1), True)]
    df = spark.createDataFrame(rows, "unit string, at timestamp, failed boolean").repartition(4)
    got = sorted(tuple(r) for r in survival.episodes(df, F.col("failed"), F.lit(END)).collect())
    want = []
    for u in {r[0] for r in rows if r[0]}:
        own = sorted((at, f) for k, at, f in rows if k == u and at and at <= END)
        start = own[0][0]
        for at in sorted({at for at, f in own if f}):
            want.append((u, start, int((at - start).total_seconds() // 3600), True))
            start = at
        want.append((u, start, int((END - start).total_seconds() // 3600), False))
    assert got == sorted(want)


def test_remaining_life(spark):
    rows = [("a", d, True) for d in (1, 2, 2, 4, 6, 8)] + [("b", 3, False)]
    curve = survival.survival_curve(spark.createDataFrame(rows, "g string, duration bigint, failed boolean"), ["g"])
    units = spark.createDataFrame(
        [("x", "a", 0), ("y", "a", 3), ("z", "a", 9), ("w", "b", 1), ("v", "c", 1), ("u", "a", None)], "unit string, g string, age bigint")
    got = {r["unit"]: (r["survival_share"], r["median_left"]) for r in survival.remaining_life(units, curve, ["g"]).collect()}
    assert got == {"x": (0.0, 2), "y": (0.0, 3), "z": (None, None), "w": (1.0, None), "v": (None, None), "u": (None, None)}


def test_remaining_life_looks_each_age_up_once(spark):
    """Many units of few ages and a long curve: the work goes by the distinct ages."""
    rows = [("a", d, True) for d in range(1, 41)] + [(None, 5, True)]
    curve = survival.survival_curve(spark.createDataFrame(rows, "g string, duration bigint, failed boolean"), ["g"])
    units = spark.range(2000).select("id", F.lit("a").alias("g"), (F.col("id") % 5).alias("age"))
    units = units.unionByName(spark.createDataFrame([(-1, None, 1), (-2, "a", 1)], "id bigint, g string, age bigint"))
    found = survival.remaining_life(units, curve, ["g"])
    got = {r["id"]: (r["survival_share"], r["median_left"]) for r in found.collect()}
    assert len(got) == 2002 and got[-1] == (0.0, 4) and got[-2] == got[1] and got[0] == (0.0, 20)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Lists are gone through above the aggregate of distinct ages, and never beside the units.
    assert all("Generate" in x or "__age" in x for x in lines if " filter(" in x) and any("Aggregate [__" in x for x in lines)
