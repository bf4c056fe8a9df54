from faultline.operators import profile

SCHEMA = "class string, full double, half double, one_null double, only_null double, same double, text string"
ROWS = [
    ("neg", 1.0, 1.0, 5.0, None, 3.0, "a"),
    ("pos", 2.0, None, None, None, 3.0, "a"),
    ("neg", 3.0, 2.0, 5.0, None, 3.0, "a"),
    (None, 4.0, None, 5.0, None, 3.0, "a"),
]


def _names(df):
    return [r[0] for r in df.collect()]


def test_two_kinds_of_constant(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert _names(profile.constant_columns_ignore_null(df)) == ["one_null", "same", "text"]
    assert _names(profile.constant_columns_null_counts(df)) == ["only_null", "same", "text"]
    assert profile.drop_constant(df).columns == ["class", "full", "half", "one_null"]


def test_exactly_half_missing_stays(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert profile.drop_high_missing(df).columns == ["class", "full", "half", "one_null", "same", "text"]
    assert _names(profile.high_missing_columns(df)) == ["only_null"]


def test_missing_profile_order_and_limits(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = [tuple(r) for r in profile.missing_profile(df).collect()]
    assert rows[0] == ("only_null", 4, 100.0) and rows[1] == ("half", 2, 50.0)
    assert rows[2:4] == [("class", 1, 25.0), ("one_null", 1, 25.0)]
    assert tuple(profile.missing_limits(df).collect()[0]) == (1, 1)
    assert profile.total_missing(df).collect()[0][0] == 8
    assert profile.total_missing(df, features_only=True).collect()[0][0] == 7


def test_target_profile_counts_missing_in_the_total(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [tuple(r) for r in profile.target_profile(df).collect()] == [("neg", 2, 50.0), ("pos", 1, 25.0)]


def test_duplicates_tell_nulls_apart(spark):
    rows = [(None, 1), (1, None), (1, None), (None, None), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert tuple(profile.duplicate_rows(df).collect()[0]) == (6, 3)


def test_one_row_repeated_many_times(spark):
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, 'x', cast(id as string)) as a")
    copies = 33_334
    assert tuple(profile.duplicate_rows(df).collect()[0]) == (100_000, copies - 1)


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tuple(profile.duplicate_rows(df).collect()[0]) == (0, 0)
    assert _names(profile.constant_columns_ignore_null(df)) == []
    assert profile.missing_profile(df).collect()[0]["missing_percentage"] is None


def test_profile_of_171_columns_is_one_job(spark):
    names = [f"s{i:03d}" for i in range(170)]
    df = spark.range(2000).selectExpr("if(id % 7 = 0, 'pos', 'neg') as class", *(
        f"if(id % {i + 2} = 0, null, cast(id % {i + 1} as double)) as {n}" for i, n in enumerate(names)))
    rows = profile.collect_profile(df)
    assert len(rows) == 171
    assert all(p.missing_count == (2000 + i + 1) // (i + 2) for i, p in enumerate(rows[1:]))
    assert rows[1].constant_ignoring_null and not rows[1].constant_counting_null


def test_post_conditions(spark):
    good = spark.createDataFrame([(0, 1.0), (1, 2.0)], "class int, a double")
    assert all(r["passed"] for r in profile.assert_processed(good, 2, 1).collect())
    bad = spark.createDataFrame([(0, None), (None, 2.0)], "class int, a double")
    failed = {r["check"] for r in profile.assert_processed(bad, 3, 2).collect() if not r["passed"]}
    assert failed == {"no_missing", "target_is_binary", "row_count", "feature_count"}
    raw = spark.createDataFrame([("neg", "1"), ("pos", "2"), (None, "3")], "class string, a string")
    assert all(r["passed"] for r in profile.assert_raw(raw, 3, 2).collect())
