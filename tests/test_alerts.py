"""Alert episodes against a plain walk over each machine's rows."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from faultline.streaming import alerts

DAY = datetime.datetime(2024, 3, 1)
HOURS = 6


def _plain(rows, end=None):
    """Episodes per machine; with ``end`` only those whose cool-down had passed by then."""
    out = []
    for machine in sorted({m for m, _, _ in rows}):
        times = {}
        for m, at, p in rows:
            if m == machine:
                times.setdefault(at, []).append(p)
        found, open_ = [], False
        for at in sorted(times):
            p = max(times[at])
            if not open_ and p >= alerts.OPEN_AT:
                open_ = True
                if found and (at - found[-1][2]).total_seconds() <= alerts.COOL_DOWN_SECONDS:
                    found[-1][2], found[-1][5] = None, found[-1][5] + 1
                else:
                    found.append([machine, at, None, p, 0, 0])
            elif open_ and p < alerts.CLOSE_AT:
                open_, found[-1][2] = False, at
            if open_:
                found[-1][3], found[-1][4] = max(found[-1][3], p), found[-1][4] + len(times[at])
        out += [tuple(f) for f in found]
    if end is not None:
        out = [f for f in out if f[2] and f[2] + datetime.timedelta(hours=HOURS) < end]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(2), []
    for m in range(6):
        level, at = 0.4, DAY
        for _ in range(300):
            at += datetime.timedelta(minutes=draw.choice([1, 20, 60, 200, 400]), microseconds=draw.randrange(999))
            level = min(1.0, max(0.0, level + draw.uniform(-0.25, 0.25)))
            out.append((f"m{m}", at, level))
            if draw.random() < 0.05:
                out.append((f"m{m}", at, draw.random()))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "row_key string, created_at timestamp, failure_probability double")


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stored_rows(spark, rows):
    odd = rows + [(None, DAY, 0.9), ("m0", None, 0.9), ("m0", DAY, None), ("m0", DAY, float("nan")), ("still", DAY, 0.95)]
    got = _got(alerts.episodes(_frame(spark, odd).repartition(5)))
    assert got == sorted(_plain(rows) + [("still", DAY, None, 0.95, 1, 0)], key=str)
    assert len(got) > 20 and any(g[5] for g in got)


def test_nothing(spark, rows):
    assert alerts.episodes(_frame(spark, rows).where("false")).count() == 0


def test_a_restarted_stream_gives_each_episode_once(spark, rows):
    root = tempfile.mkdtemp(prefix="run-")
    ordered = sorted(rows, key=lambda r: r[1])
    last = ordered[-1][1] + datetime.timedelta(days=3)
    parts = [ordered[k * len(ordered) // 4:(k + 1) * len(ordered) // 4] for k in range(4)] + [[("clock", last, 0.1)]]
    for k, part in enumerate(parts):
        _frame(spark, part).coalesce(1).write.mode("append").parquet(root + "/in")
        stream = spark.readStream.schema("row_key string, created_at timestamp, failure_probability double").parquet(root + "/in")
        run = (alerts.episode_stream(stream, late="0 seconds").writeStream.outputMode("append").format("parquet")
               .option("checkpointLocation", root + "/state").option("path", root + "/out").trigger(availableNow=True).start())
        run.awaitTermination()
    assert _got(spark.read.parquet(root + "/out")) == _plain(rows, last)
