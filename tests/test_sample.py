import hashlib

import pytest
from pyspark.sql import functions as F

from faultline.operators import sample


def _rows(n=3000):
    return [(f"k{i}", "pos" if i % 10 == 0 else "neg" if i % 7 else None, i) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "row_key string, class string, v int").repartition(5)


def _rank(rows, c, seed=42):
    return sorted((r for r in rows if r[1] == c), key=lambda r: hashlib.md5(f"{seed}{r[0]}".encode()).hexdigest())


@pytest.fixture(params=["default", "deep"])
def levels(request, monkeypatch):
    if request.param == "deep":
        monkeypatch.setattr(sample, "_DIGITS", 1)
        monkeypatch.setattr(sample, "_RANK_ROWS", 3)
        monkeypatch.setattr(sample, "_CHUNK", 7)


def test_first_rows_follow_the_hash(spark, levels):
    rows = _rows()
    have = {tuple(r) for r in sample.first_per_class(_frame(spark, rows), 55).collect()}
    assert have == {r for c in ("pos", "neg", None) for r in _rank(rows, c)[:55]}


def test_split_is_disjoint_and_complete(spark, levels):
    rows = _rows()
    split = sample.split_per_class(_frame(spark, rows), 100).collect()
    assert len(split) == len(rows)
    assert {tuple(r)[:3] for r in split} == set(rows)
    train = {tuple(r)[:3] for r in split if r["split"] == "train"}
    assert train == {r for c in ("pos", "neg", None) for r in _rank(rows, c)[:100]}


def test_same_rows_under_any_partitioning(spark):
    df = _frame(spark, _rows(800))
    pick = [sorted(tuple(r) for r in sample.split_per_class(d, 31).collect()) for d in (
        df.repartition(1).na.fill("none"), df.repartition(7).na.fill("none"), df.orderBy(F.rand(1)).na.fill("none"))]
    assert pick[0] == pick[1] == pick[2]


@pytest.mark.parametrize("k", [0, 1, 500, 1001, 5000, 6001, 99999])
def test_copies_of_one_key_are_counted_exactly(spark, levels, k):
    """A third of the class is one row repeated; whatever the cut, the counts hold."""
    rows = [("same", "neg", 7)] * 2000 + [(f"k{i}", "neg", i) for i in range(4000)]
    split = sample.split_per_class(_frame(spark, rows), k)
    counts = {r[0]: r[1] for r in split.groupBy("split").count().collect()}
    assert counts.get("train", 0) == min(k, 6000) and counts.get("test", 0) == 6000 - min(k, 6000)
    assert split.filter("row_key = 'same' and v = 7").count() == 2000
    assert split.select("row_key", "v").distinct().count() == 4001


def test_one_key_with_different_rows(spark, levels):
    rows = [("same", "neg", i % 50) for i in range(2000)]
    first = sample.first_per_class(_frame(spark, rows), 777)
    rest = sample.test_split_per_class(_frame(spark, rows), 777)
    assert first.count() == 777 and rest.count() == 1223
    both = {r[0]: r[1] for r in first.unionByName(rest).groupBy("v").count().collect()}
    assert both == {i: 40 for i in range(50)}


def _quota(spark, counts):
    frame = spark.createDataFrame([(c, n) for c, n in counts.items()], "by string, n bigint")
    return {r["by"]: r["wanted"] for r in sample.stratified()(frame).collect()}


def test_shares_of_the_published_split(spark):
    assert _quota(spark, {"neg": 59000, "pos": 1000}) == {"neg": 47200, "pos": 800}
    assert sum(_quota(spark, {"a": 5, "b": 5, "c": 1}).values()) == 8


def test_balance_keeps_all_when_few(spark):
    rows = [(f"k{i}", "pos" if i < 30 else "neg", i) for i in range(50)]
    assert sample.balance_classes(_frame(spark, rows), 1000).count() == 50
    few = sample.balance_classes(_frame(spark, rows), 5)
    assert {r[0]: r[1] for r in few.groupBy("class").count().collect()} == {"pos": 30, "neg": 5}


def test_samples_of_any_size(spark):
    rows = _rows(2000)
    df = _frame(spark, rows)
    order = sorted(rows, key=lambda r: hashlib.md5(f"42{r[0]}".encode()).hexdigest())
    for n in (1, 150, 1999, 99999):
        assert {tuple(r) for r in sample.sample_n(df, n).collect()} == set(order[:n])


def test_a_shared_key_gives_one_sample_under_any_partitioning(spark):
    rows = [("same", "neg", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_key string, class string, v int")
    picks = [sorted(r["v"] for r in sample.sample_n(d, 5).collect()) for d in (
        df.repartition(1), df.repartition(7), df.orderBy(F.rand(3)))]
    assert len(picks[0]) == 5 and picks[0] == picks[1] == picks[2]


def test_many_classes(spark):
    df = spark.range(3000).selectExpr("cast(id as string) as row_key", "cast(id % 500 as string) as class", "1 as v")
    assert sample.first_per_class(df, 2).groupBy("class").count().where("count = 2").count() == 500


def test_ranks(spark, levels):
    rows = _rows(900) + [("same", "neg", 5)] * 40
    ranked = sample.row_number_per_class(_frame(spark, rows), 120).collect()
    for c in ("pos", "neg", None):
        part = sorted((r["row_number"], r["row_key"], r["v"]) for r in ranked if r["class"] == c)
        want = _rank(rows, c)[:120]
        assert part == [(i + 1, r[0], r[2]) for i, r in enumerate(want)]


def test_empty(spark):
    none = _frame(spark, _rows(5)).where("false")
    assert sample.sample_n(none, 3).count() == 0 and sample.exact_stratified_split(none).count() == 0
    assert sample.row_number_per_class(none, 3).count() == 0


def test_places_are_counted_without_a_sort_of_all_rows(spark):
    places = spark.range(5_000).selectExpr("if(id % 50 = 0, 'pos', 'neg') AS by", "md5(CAST(id % 900 AS STRING)) AS place")
    pending = spark.createDataFrame([("pos", "", 20), ("neg", "", 3_000)], "by string, at string, wanted bigint")
    counts = sample._prefix_counts(places, pending)
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    assert counts.groupBy("by").sum("n").orderBy("by").collect() == [("neg", 4_900), ("pos", 100)]


def test_one_key_on_most_rows_goes_straight_to_its_place(spark):
    """Whatever stands at the cutoff: a key of many rows, equal or not, beside single ones."""
    rows = spark.range(3_000).selectExpr(
        "if(id < 2500, 'hot', CAST(id AS STRING)) AS row_key", "'neg' AS class", "CAST(if(id < 1200, 0, id) AS STRING) AS x")
    for k in (700, 2_900):
        both = sample.split_per_class(rows, k)
        assert both.where("split = 'train'").count() == k and both.count() == 3_000
        assert both.drop("split").exceptAll(rows).isEmpty()
