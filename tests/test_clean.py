import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions import expressions as X
from faultline.operators import clean

CELLS = ["1", " 2 ", "+3", "-4.5", ".5", "5.", "1e3", "inf", "-Infinity", "na", " na ", "NA", "NaN", "", "1d", "1.5f",
         "bad", "--", "1e", "0x1p3", "1 2", None]


def test_to_double_agrees_with_pandas(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, c string")
    have = [r[1] for r in df.select("i", X.to_double("c")).orderBy("i").collect()]
    want = pd.to_numeric(pd.Series(CELLS), errors="coerce").tolist()
    assert have == [None if math.isnan(w) else w for w in want]


def test_strict_number_rounds_and_knows_one_token(spark):
    rows = [("12.5",), (" na ",), ("-0.5",), ("NA",), ("7",), ("nan",)]
    df = spark.createDataFrame(rows, "a string").withColumn("class", F.lit("neg"))
    have = [None if r[0] is None else int(r[0]) for r in clean.clean_numeric_strict(df).select("a").collect()]
    assert have == [13, None, -1, None, 7, None]
    kept = [r[0] for r in clean.clean_numeric_strict(df, scale=None).select("a").collect()]
    assert kept == [12.5, None, -0.5, None, 7.0, None]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"]).toDF(" Class ", "\tx_000")
    assert clean.trim_column_names(df).columns == ["Class", "x_000"]
    assert clean.upper_column_names(df).columns == [" CLASS ", "\tX_000"]
    with pytest.raises(ValueError, match="collide"):
        clean.trim_column_names(df.toDF("a", "A "))


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([("neg", float("nan")), ("pos", 1.0)], "class string, x double")
    assert [r[0] for r in clean.to_numeric(df).select("x").collect()] == [None, 1.0]


def test_require_features_lists_every_missing_one(spark):
    df = spark.createDataFrame([("1", "x")], "aa_000 string, other string")
    with pytest.raises(ValueError, match="BB_000, CC_000"):
        clean.require_features(df, ["AA_000", "BB_000", "CC_000"])
    ready = clean.require_features(df, ["AA_000"])
    assert ready.columns == ["AA_000"] and ready.collect()[0][0] == 1.0


def test_exclude_needs_the_columns(spark):
    with pytest.raises(ValueError, match="absent"):
        clean.exclude_columns(spark.range(1))


def test_encode_and_drop(spark):
    df = spark.createDataFrame([("neg", 1.0), ("pos", None), ("odd", 2.0), (None, 3.0), ("pos", 4.0)], "class string, x double")
    kept = clean.drop_incomplete_rows(clean.encode_target(df, out="label"), ["x"])
    assert sorted((r["label"], r["x"]) for r in kept.collect()) == [(0, 1.0), (1, 4.0)]


def test_decision_edges(spark):
    p = [0.0, 0.29999, 0.30, 0.50, 0.70, 0.80, 0.95, 1.0, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double").orderBy("i")
    risk = [r[0] for r in df.select(X.risk_level("p")).collect()]
    priority = [r[0] for r in df.select(X.maintenance_priority("p")).collect()]
    label = [r[0] for r in df.select(X.threshold_label("p")).collect()]
    assert risk == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "HIGH", "HIGH", "LOW", "LOW"]
    assert priority == ["NORMAL", "NORMAL", "NORMAL", "MONITOR", "MONITOR", "URGENT", "CRITICAL", "CRITICAL", "NORMAL", "NORMAL"]
    assert label == [0, 0, 0, 1, 1, 1, 1, 1, 0, 0]


def test_percent_text(spark):
    df = spark.createDataFrame([(0.1234,), (1.0,), (None,)], "p double")
    assert [r[0] for r in df.select(X.format_percent("p")).collect()] == ["12.34%", "100.00%", None]


def test_schema_lists():
    assert len(S.TOP_FEATURES) == 20 and len(S.EXCLUDED_FEATURES) == 8
    assert len(S.SWEEP_HUNDREDTHS) == 17


def test_wide_queries_compile_in_pieces_in_any_session(spark):
    """A session that was built elsewhere has another limit; wide stages would run interpreted."""
    from faultline import fixtures

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "65535")
    try:
        fixtures.table(spark, "/root/testdata/sf0.001", "lineitem")
        assert spark.conf.get(key) == "8000"
    finally:
        spark.conf.set(key, before)


def test_to_number_makes_the_text_of_a_cell_twice_at_most(spark):
    from pyspark.sql import functions as F

    from faultline.functions import expressions as X

    cells = [" 12 ", "\t7.5\n", "na", " na ", "NaN", "", "1d", "-1", "1e3", "inf", "bad", None]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    got = [r[0] for r in df.select(X.to_number("x")).collect()]
    assert [None if v is None else int(v) for v in got] == [12, 8, None, None, None, None, None, -1, 1000, None, None, None]
    assert [r[0] for r in df.select(X.to_number("x", tokens=("na", "-1"))).collect()][7] is None
    made = df.select(X.to_number(F.reverse("x")).alias("n"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 2
