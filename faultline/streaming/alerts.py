"""Failure alerts per machine: episodes with hysteresis and a cool-down, stored or streamed.

A row of a key at or above ``open_at`` opens an episode, one below ``close_at`` closes it; what
is in between changes nothing. An episode that opens again within the cool-down after it was
closed is the same one. Rows are taken by time; a row without a score or time is no row.

Stored rows: the state after a row is the last mark up to it. Marks are filled forward inside
(key, day), and the state that a day begins with comes from a row per key and day; so no key is
sorted as a whole, and a key with a third of all rows is as many groups as it has days. What is
grouped by key alone are stretches, one row each. Streams keep a row of state per key that is
not at rest, and a timer for the end of its cool-down.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline import schema as S

OPEN_AT, CLOSE_AT, COOL_DOWN_SECONDS = 0.7, 0.5, 6 * 3600
P = "failure_probability"
#: Times are microseconds since the epoch, whatever zone a worker is in.
_EPISODES = "machine string, opened bigint, closed bigint, peak double, rows bigint, reopened bigint"
_STATE = "open boolean, opened bigint, closed bigint, peak double, rows bigint, reopened bigint, last bigint"


def _rows(predictions: DataFrame, key: str, time: str) -> DataFrame:
    p = F.col(P).cast("double")
    rows = predictions.select(F.col(key).cast("string").alias("machine"), F.col(time).cast("timestamp").alias("at"), p.alias("p"))
    return rows.where(F.col("machine").isNotNull() & F.col("at").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))


def episodes(
    predictions: DataFrame, key: str = S.ROW_KEY, time: str = "created_at", open_at: float = OPEN_AT, close_at: float = CLOSE_AT,
    cool_down: int = COOL_DOWN_SECONDS,
) -> DataFrame:
    """One row per episode: machine, opened_at, closed_at (null while open), peak, rows while open, how often it reopened.

    Rows of a machine at the same time count as one, with the highest score.
    """
    once = _rows(predictions, key, time).groupBy("machine", "at").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("n"))
    mark = F.when(F.col("p") >= open_at, 1).when(F.col("p") < close_at, 0)
    rows = once.select("*", F.to_date("at").alias("day"), mark.alias("mark"))
    days = rows.groupBy("machine", "day").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("last"))
    before = W.partitionBy("machine").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(
        F.col("machine").alias("m"), F.col("day").alias("d"), F.coalesce(F.last("last", True).over(before), F.lit(0)).alias("begins"))
    inside = W.partitionBy("machine", "day").orderBy("at")
    rows = rows.join(days, (F.col("machine") == F.col("m")) & (F.col("day") == F.col("d")))
    rows = rows.withColumn("state", F.coalesce(F.last("mark", True).over(inside), F.col("begins")))
    rows = rows.withColumn("earlier", F.coalesce(F.lag("state").over(inside), F.col("begins")))
    turned = F.when(F.col("state") != F.col("earlier"), F.col("at"))
    rows = rows.withColumn("opened", F.when(F.col("state") == 1, turned))
    # The opening that a row belongs to: inside its day, else the last one of an earlier day.
    openings = rows.groupBy("machine", "day").agg(F.max("opened").alias("opened"))
    openings = openings.select(
        F.col("machine").alias("m2"), F.col("day").alias("d2"), F.last("opened", True).over(before).alias("carried"))
    rows = rows.join(openings, (F.col("machine") == F.col("m2")) & (F.col("day") == F.col("d2")))
    rows = rows.withColumn("stretch", F.coalesce(F.last("opened", True).over(inside), F.col("carried")))
    closing = F.min(F.when((F.col("state") == 0) & (F.col("earlier") == 1), F.col("at")))
    active = F.col("state") == 1
    stretches = rows.where(active | (F.col("earlier") == 1)).groupBy("machine", "stretch").agg(
        F.max(F.when(active, F.col("p"))).alias("peak"), F.sum(F.when(active, F.col("n")).otherwise(0)).alias("n"), closing.alias("closed"))
    ordered = W.partitionBy("machine").orderBy("stretch")
    fresh = F.coalesce(F.col("stretch").cast("double") - F.lag("closed").over(ordered).cast("double") > cool_down, F.lit(True))
    numbered = stretches.withColumn("fresh", fresh.cast("int")).withColumn("episode", F.sum("fresh").over(ordered))
    return numbered.groupBy("machine", "episode").agg(
        F.min("stretch").alias("opened_at"), F.max_by(F.struct("closed"), "stretch").alias("end"), F.max("peak").alias("peak"),
        F.sum("n").alias("rows"), (F.count(F.lit(1)) - 1).alias("reopened"),
    ).select("machine", "opened_at", F.col("end.closed").alias("closed_at"), "peak", "rows", "reopened")


def episode_stream(
    predictions: DataFrame, key: str = S.ROW_KEY, time: str = "created_at", open_at: float = OPEN_AT, close_at: float = CLOSE_AT,
    cool_down: int = COOL_DOWN_SECONDS, late: str = "1 hour",
) -> DataFrame:
    """The same episodes from a stream: each one row, once its cool-down has passed without a reopening.

    State and timers are in the checkpoint, so a restart neither repeats nor loses an episode.
    A row older than the watermark, or than the newest row that its machine's state has seen, is
    late and dropped: micro-batches have to bring a machine's rows in order.
    """
    rows = _rows(predictions, key, time).withWatermark("at", late).withColumn("us", F.unix_micros("at"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, out = group[0], []
        open_, opened, closed, peak, n, again, last = state.get if state.exists else (False, None, None, None, 0, 0, None)
        if state.hasTimedOut:
            out.append((machine, opened, closed, peak, n, again))
            state.remove()
        else:
            batch = pd.concat(list(frames)).groupby("us")["p"].agg(["max", "size"]).sort_index()
            for at, p, size in zip(batch.index.tolist(), batch["max"].tolist(), batch["size"].tolist()):
                if last is not None and at <= last:
                    continue
                last = at
                if closed is not None and at - closed > cool_down * 1_000_000:
                    out.append((machine, opened, closed, peak, n, again))
                    opened, closed, peak, n, again = None, None, None, 0, 0
                if not open_ and p >= open_at:
                    open_, closed = True, None
                    if opened is None:
                        opened = at
                    else:
                        again += 1
                elif open_ and p < close_at:
                    open_, closed = False, at
                if open_:
                    peak, n = p if peak is None else max(peak, p), n + size
            if opened is not None:
                state.update((open_, opened, closed, peak, n, again, last))
                if closed is not None:
                    state.setTimeoutTimestamp(max(closed // 1_000 + cool_down * 1_000 + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame({name: pd.Series([row[k] for row in out], dtype="object") for k, name in enumerate(
            ("machine", "opened", "closed", "peak", "rows", "reopened"))})

    found = rows.select("machine", "at", "us", "p").groupBy("machine").applyInPandasWithState(
        step, _EPISODES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        "machine", F.timestamp_micros("opened").alias("opened_at"), F.timestamp_micros("closed").alias("closed_at"),
        "peak", "rows", "reopened")
