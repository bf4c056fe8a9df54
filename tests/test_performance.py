"""Performance with late labels: plain counts, and the same from a stream."""

import datetime
import random
import tempfile

import pytest

from faultline.streaming import performance

DAY = datetime.datetime(2024, 3, 1)
PREDICTIONS = "row_key string, created_at timestamp, failure_probability double, prediction int"
LABELS = "row_key string, labelled_at timestamp, label int"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    made, said = [], []
    for k in range(600):
        at = DAY + datetime.timedelta(minutes=k * 24)
        p = round(draw.random(), 3)
        made.append((f"k{k}", at, p, int(p >= 0.5)))
        if draw.random() < 0.8:
            said.append((f"k{k}", at + datetime.timedelta(hours=draw.choice([0, 1, 20, 47, 48, 60])), int(draw.random() < p)))
    return made, said


def _plain(made, said):
    label = {k: (at, y) for k, at, y in said}
    out = {}
    for k, at, p, guess in made:
        came = label.get(k)
        y = came[1] if came and at <= came[0] <= at + datetime.timedelta(days=2) else None
        out.setdefault(at.date(), []).append((p, guess, y))
    rows = {}
    for day, part in out.items():
        known = [x for x in part if x[2] is not None]
        tp, fp, fn, tn = (sum(g == a and y == b for _, g, y in known) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
        rows[day] = (
            len(part), len(known), len(part) - len(known), tp, fp, fn, tn, tp / (tp + fp) if tp + fp else None,
            tp / (tp + fn) if tp + fn else None, pytest.approx(sum((p - y) ** 2 for p, _, y in known) / len(known)) if known else None)
    return rows


def _by_day(df):
    return {r["period_start"].date(): tuple(r)[2:] for r in df.collect()}


def test_stored_tables(spark, rows):
    made, said = rows
    odd = made + [(None, DAY, 0.5, 1), ("null", DAY, None, None)]
    got = _by_day(performance.performance(performance.with_late_labels(
        spark.createDataFrame(odd, PREDICTIONS).repartition(3), spark.createDataFrame(said + [("null", DAY, 1)], LABELS))))
    want = _plain(made, said)
    first = DAY.date()
    assert {d: v for d, v in got.items() if d != first} == {d: v for d, v in want.items() if d != first}
    n, known, unlabelled, *measures = want[first]
    assert got[first] == (n + 2, known + 1, unlabelled + 1, *measures)


def test_no_rows(spark, rows):
    made, said = (spark.createDataFrame(r, s) for r, s in zip(rows, (PREDICTIONS, LABELS)))
    assert performance.performance(performance.with_late_labels(made.where("false"), said)).count() == 0
    bare = performance.performance(performance.with_late_labels(made, said.where("false"))).collect()
    assert all(r["labelled"] == 0 and r["precision"] is None and r["brier"] is None for r in bare) and len(bare) == 10


def test_a_stream_agrees_and_its_state_does_not_grow(spark, rows):
    made, said = rows
    root = tempfile.mkdtemp(prefix="run-")
    steps, held = 12, []
    for k in range(steps + 1):
        until = DAY + datetime.timedelta(days=k), DAY + datetime.timedelta(days=k + 1)
        parts = [[r for r in side if until[0] <= r[1] < until[1]] for side in (made, said)]
        if k == steps:
            late = DAY + datetime.timedelta(days=40)
            parts = [[("clock", late, 0.1, 0)], [("clock", late, 0)]]
        for name, part, schema in zip(("made", "said"), parts, (PREDICTIONS, LABELS)):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(s).parquet(f"{root}/{n}") for n, s in (("made", PREDICTIONS), ("said", LABELS))]
        run = (performance.performance(performance.with_late_labels(*streams, late="0 seconds")).writeStream.outputMode("append")
               .format("parquet").option("checkpointLocation", root + "/state").option("path", root + "/out").trigger(availableNow=True).start())
        run.awaitTermination()
        held.append(sum(o["numRowsTotal"] for o in run.lastProgress["stateOperators"]))
    got = _by_day(spark.read.parquet(root + "/out"))
    want = _plain(made, said)
    assert len(got) >= 9 and all(got[d] == want[d] for d in got if d in want)
    assert max(held[4:10]) < 3 * max(held[:4])
