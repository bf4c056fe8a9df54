"""Bootstrap intervals against resampling rows one by one."""

import numpy as np
import pytest

from faultline.operators import benchmark


def _areas(score, y, w):
    order = np.argsort(-score, kind="stable")
    score, y, w = score[order], y[order], w[order]
    cuts = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
    p, n = (np.add.reduceat(w * (y == k), cuts) for k in (1, 0))
    hits, wrong = np.cumsum(p), np.cumsum(n)
    seen = hits + wrong > 0
    return (n * (hits - p / 2)).sum() / (p.sum() * n.sum()), (p[seen] * hits[seen] / (hits + wrong)[seen]).sum() / p.sum()


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(2)
    n = 1_500
    y = (draw.random(n) < 0.2).astype(int)
    a = np.clip(0.3 + 0.25 * y + 0.2 * draw.normal(size=n), 0, 1).round(2)
    b = np.clip(0.7 * a + 0.1 * y + 0.1 * draw.normal(size=n), 0, 1).round(3)
    a[:500], y[:500] = 0.5, draw.random(500) < 0.2
    return a, b, y


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(float(a), float(b), int(y)) for a, b, y in zip(*data)]
    return spark.createDataFrame(rows + [(None, 0.1, 1), (0.3, float("nan"), 0), (0.2, 0.2, None)], "a double, b double, label int").repartition(4)


def test_estimates_and_intervals(frame, data):
    a, b, y = data
    got = {(r["model"], r["measure"], r["kind"]): r for r in benchmark.benchmark(frame, ["a", "b"], count=400).collect()}
    assert len(got) == 6
    exact = {m: _areas(s, y, np.ones(len(y))) for m, s in (("a", a), ("b", b))}
    draw = np.random.default_rng(9)
    runs = []
    for _ in range(2_000):
        w = draw.poisson(1, len(y)).astype(float)
        runs.append([*_areas(a, y, w), *_areas(b, y, w)])
    runs = np.array(runs)
    for k, measure in enumerate(("roc_auc", "average_precision")):
        for m, own in (("a", runs[:, k]), ("b", runs[:, 2 + k])):
            r = got[m, measure, "value"]
            assert r["estimate"] == pytest.approx(exact[m][k], abs=1e-12) and r["replicates"] == 400
            assert r["mean"] == pytest.approx(own.mean(), abs=4 * own.std() / 20)
            assert r["deviation"] == pytest.approx(own.std(), rel=0.15)
            assert (r["low"], r["high"]) == pytest.approx(tuple(np.percentile(own, [2.5, 97.5])), abs=0.5 * own.std())
        r, own = got["b", measure, "difference"], runs[:, 2 + k] - runs[:, k]
        assert r["estimate"] == pytest.approx(exact["b"][k] - exact["a"][k], abs=1e-12)
        assert r["deviation"] == pytest.approx(own.std(), rel=0.15) and r["mean"] == pytest.approx(own.mean(), abs=4 * own.std() / 20)


def test_ranges_and_partitions_change_nothing(frame, monkeypatch):
    cells = benchmark.merged_cells(frame, ["a", "b"])
    one = sorted(tuple(r) for r in benchmark.replicates(cells, "s1", 30).collect())
    monkeypatch.setattr(benchmark, "RANGE_CELLS", 97)
    monkeypatch.setattr(benchmark, "AT_ONCE", 7)
    many = sorted(tuple(r) for r in benchmark.replicates(benchmark.merged_cells(frame.repartition(9), ["a", "b"]), "s1", 30).collect())
    assert np.allclose(one, many, atol=1e-12)


@pytest.mark.parametrize("count", [1, 7, 64, 65, 5_000])
def test_weights_are_poisson(count):
    cells = np.arange(40_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = benchmark.drawn(cells, np.full(40_000, count), 3, 1, 42)
    assert w.mean() == pytest.approx(count, abs=5 * (count / 40_000) ** 0.5) and w.var() == pytest.approx(count, rel=0.05)


def test_one_class_and_no_rows(spark, frame):
    for rows in (frame.where("label = 1"), frame.where("false")):
        out = benchmark.benchmark(rows, ["a"], count=5).collect()
        assert all(r["estimate"] is None or r["measure"] == "average_precision" for r in out)
