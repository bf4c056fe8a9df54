import numpy as np
import pytest

from faultline.operators import impute


def _frame(spark, columns):
    n = len(next(iter(columns.values())))
    rows = [tuple(None if np.isnan(columns[c][i]) else float(columns[c][i]) for c in columns) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(7)


def _columns(n=4001):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=n)
    hot[rng.random(n) < 0.4] = 1.25
    edge = np.where(np.arange(n) < n // 2, 0.0, 1.0)
    gaps = rng.exponential(size=n)
    gaps[rng.random(n) < 0.3] = np.nan
    wide = rng.choice([-1e300, -1.0, 1e-300, 1.0, 1e300], size=n)
    return {"normal": rng.normal(size=n), "hot": hot, "edge": edge, "gaps": gaps, "wide": wide,
            "none": np.full(n, np.nan), "even": np.concatenate([rng.normal(size=n - 1), [np.nan]])}


@pytest.mark.parametrize("options", [{}, {"accuracy": 50}, {"accuracy": 10}, {"accuracy": 2}])
def test_median_is_exact(spark, options):
    columns = _columns()
    have = impute.fit_medians(_frame(spark, columns), list(columns), **options).medians
    for c, v in columns.items():
        known = v[~np.isnan(v)]
        assert have[c] == (float(np.median(known)) if len(known) else None), c


def test_values_a_sketch_cannot_narrow(spark):
    columns = _columns()
    brackets = {c: impute._Bracket(((n + 1) // 2, n // 2 + 1), inside=n) for c in columns if (n := int((~np.isnan(columns[c])).sum()))}
    have = impute._medians_by_bisection(_frame(spark, columns), brackets)
    assert have == {c: float(np.nanmedian(columns[c])) for c in brackets}


def test_even_and_odd(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 10.0), (None, 20.0)], "odd double, even double")
    assert dict(impute.fit_medians(df, ["odd", "even"]).medians) == {"odd": 2.0, "even": 6.0}
    filled = impute.median_impute(df, ["odd", "even"])
    assert sorted(r[0] for r in filled.collect()) == [1.0, 2.0, 2.0, 4.0]


def test_fit_on_other_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    test = spark.createDataFrame([(None,), (9.0,)], "a double")
    assert sorted(r[0] for r in impute.median_impute(test, ["a"], train).collect()) == [2.0, 9.0]


def test_population_deviation_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, k double")
    z = impute.standardize(df, ["a", "k"]).toPandas()
    a = np.array([1.0, 2.0, 6.0])
    assert np.allclose(sorted(z["a"]), sorted((a - a.mean()) / a.std()))
    assert (z["k"] == 0).all()
