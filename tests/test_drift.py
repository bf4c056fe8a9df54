"""Drift against counts in plain numpy."""

import math
import tempfile

import numpy as np
import pytest

from faultline.operators import drift


def _frame(spark, columns):
    names = list(columns)
    rows = list(zip(*(c for c in columns.values())))
    return spark.createDataFrame(
        [tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"{n} double" for n in names)).repartition(4)


def _plain(a, b, buckets):
    """Index and largest distance by sorting."""
    present = [np.array([v for v in side if v is not None and not math.isnan(v)]) for side in (a, b)]
    ordered = np.sort(present[0])
    edges = sorted({ordered[math.ceil(len(ordered) * i / buckets) - 1] for i in range(1, buckets)} - {ordered[-1]}) if len(ordered) else []
    counts = []
    for side, x in zip((a, b), present):
        bucket = np.searchsorted(edges, x, side="left")
        counts.append([len(side) - len(x), *np.bincount(bucket, minlength=len(edges) + 1)])
    k = len(edges) + 2
    shares = [(np.array(c) + 0.5) / (len(side) + 0.5 * k) for c, side in zip(counts, (a, b))]
    psi = float(np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0])))
    steps = [np.cumsum(c[1:]) / len(x) if len(x) else None for c, x in zip(counts, present)]
    return psi, None if steps[0] is None or steps[1] is None else float(np.abs(steps[0] - steps[1]).max())


@pytest.fixture(scope="module")
def sides(spark):
    draw = np.random.default_rng(1)
    n = 4_000
    one = {
        "same": draw.normal(size=n), "moved": draw.normal(size=n), "wider": draw.normal(size=n), "few": draw.integers(0, 3, n),
        "constant": np.full(n, 7.0), "empty": [None] * n, "gone": draw.normal(size=n),
        "gaps": [None if k % 9 == 0 else float("nan") if k % 11 == 0 else v for k, v in enumerate(draw.normal(size=n))]}
    m = 3_000
    two = {
        "same": draw.normal(size=m), "moved": draw.normal(size=m) + 0.8, "wider": draw.normal(size=m) * 3, "few": draw.integers(1, 3, m),
        "constant": np.full(m, 7.0), "empty": [None] * m, "gone": [None] * m,
        "gaps": [None if k % 2 == 0 else v for k, v in enumerate(draw.normal(size=m))]}
    return one, two


def test_measures_equal_plain_counts(spark, sides):
    one, two = sides
    path = tempfile.mkdtemp(prefix="run-") + "/reference"
    drift.save_reference(drift.fit_reference(_frame(spark, one), list(one), accuracy=100_000), path)
    rows = {r["feature"]: r for r in drift.drift(drift.load_reference(spark, path), _frame(spark, two)).collect()}
    assert set(rows) == set(one)
    for f in one:
        psi, distance = _plain(list(one[f]), list(two[f]), drift.BUCKETS)
        assert rows[f]["psi"] == pytest.approx(psi, abs=1e-9), f
        assert rows[f]["max_distance"] == (None if distance is None else pytest.approx(distance, abs=1e-12)), f
        assert (rows[f]["reference_rows"], rows[f]["current_rows"]) == (4_000, 3_000)
    assert {f: r["level"] for f, r in rows.items()} == {
        "same": "stable", "moved": "shifted", "wider": "shifted", "few": "shifted", "constant": "stable", "empty": "stable",
        "gone": "shifted", "gaps": "shifted"}
    assert rows["gaps"]["current_missing"] == 1_500 and rows["gone"]["max_distance"] is None and rows["constant"]["max_distance"] == 0


def test_an_equal_batch_has_no_drift(spark, sides):
    frame = _frame(spark, sides[0])
    for r in drift.drift(drift.fit_reference(frame, frame.columns), frame.repartition(2)).collect():
        assert r["psi"] == 0 and not r["max_distance"] and r["level"] == "stable"


def test_nothing_to_compare(spark, sides):
    frame = _frame(spark, sides[0])
    reference = drift.fit_reference(frame, frame.columns)
    assert {(r["psi"], r["level"], r["current_rows"]) for r in drift.drift(reference, frame.where("false")).collect()} == {(None, "unknown", 0)}
    none = drift.fit_reference(frame.where("false"), frame.columns)
    assert {(r["psi"], r["level"]) for r in drift.drift(none, frame).collect()} == {(None, "unknown")}
