"""Recommendations under a budget against a greedy walk over all changes."""

import random

import pytest

from faultline.operators import recommend


def _frame(spark, rows):
    return spark.createDataFrame(rows, "machine string, action string, cost double, benefit double").repartition(3)


def _greedy(rows, budget):
    """Changes of all machines by price; the plain way."""
    by = {}
    for m, a, c, b in rows:
        by.setdefault(m, []).append((c, b, a))
    steps = []
    for m, own in by.items():
        hull = recommend._hull(own)
        steps += [((y[1] - x[1]) / (y[0] - x[0]), y[0] - x[0], y[1] - x[1]) for x, y in zip(hull, hull[1:])]
    spent = gained = 0.0
    for price, cost, benefit in sorted(steps, reverse=True):
        if spent + cost > budget:
            break
        spent, gained = spent + cost, gained + benefit
    return spent, gained, max((b for _, _, b in steps), default=0.0)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    return [
        (f"m{k}", action, float(draw.randrange(1, 40)), float(draw.randrange(1, 400)))
        for k in range(300) for action in ("inspect", "repair", "replace") if draw.random() < 0.8]


@pytest.mark.parametrize("budget", [0.0, 3.0, 50.0, 1_000.0, 4_000.0, 1e9])
def test_as_good_as_greedy_and_within_the_budget(spark, rows, budget):
    chosen = recommend.recommended(_frame(spark, rows), budget).collect()
    spent, gained, largest = _greedy(rows, budget)
    assert sum(r["cost"] for r in chosen) <= budget + 1e-9
    assert sum(r["benefit"] for r in chosen) >= gained - largest
    offers = {(m, a, c, b) for m, a, c, b in rows}
    assert all((r["machine"], r["action"], round(r["cost"], 6), round(r["benefit"], 6)) in offers for r in chosen)
    assert len({r["machine"] for r in chosen}) == len(chosen)


def test_equal_prices_share_the_rest_exactly(spark):
    rows = [(f"m{k}", "fix", 2.0, 10.0) for k in range(500)] + [("best", "fix", 1.0, 100.0)]
    for budget, count in ((1.0, 1), (101.0, 51), (102.0, 51), (2_000.0, 501)):
        assert recommend.recommended(_frame(spark, rows), budget).count() == count


def test_odd_options(spark):
    rows = [(None, "a", 1.0, 1.0), ("x", "a", 0.0, 5.0), ("x", "b", None, 5.0), ("x", "c", 1.0, float("nan")), ("x", "d", 2.0, -1.0), ("y", None, 1.0, 2.0), ("y", None, 1.0, 2.0)]
    assert [tuple(r) for r in recommend.recommended(_frame(spark, rows), 10.0).collect()] == [("y", "", 1.0, 2.0)]
    assert recommend.recommended(_frame(spark, rows).where("false"), 10.0).count() == 0
