"""Repeated windows of bytes by a depth-limited radix sort of suffixes, most significant digit first.

Suffixes matter through ``window`` bytes only; equal groups at that depth are the windows that
occur more than once. Each pass sorts what is still open by one more digit and keeps the
groups of at least two.

1. First digit: the least gram (``GRAM`` bytes, by hash) in the suffix's first ``window``
   bytes, and how far in it stands. Equal windows agree on both. Neighbouring suffixes share
   the gram, so a run of them, some ``(window - GRAM) / 2`` long, travels as one row. A run
   whose gram stands nowhere else is unique and leaves.
2. A run whose bytes, from its first suffix to the end of its last window, stand elsewhere too
   is repeated as a whole. What stays open are the ends of repeated text; of the repeated runs
   with the same gram one of each kind goes on beside them.
3. Next digit: open runs are cut at every ``STEP``-th distance to the gram. The bytes that all
   windows of such a step have in common are the digit; where they stand nowhere else the step
   leaves. Steps repeated as a whole are done, as before.
4. Last digit: single windows.

Every pass is an aggregate of hashes, merged before the shuffle, and a join with those that
occur twice or more: 64 bits for digits, which only prune, 128 bits for what is repeated. No
group is ever gathered, so one passage in a third of all texts is a hot key of a plain join at
most. A text is known by its digest: its rows need no numbering, and copies share their spans.
Texts are compressed and written once, and move so by digest, twice to be cut up and once to be
cleaned; no task has two Python workers. What a pass wrote is deleted when its spans and open
rows are written.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from faultline.session import scratch_path, scratch_scope
from faultline.sources.tables import stage, write_stage

WINDOW = 400
GRAM = 64
STEP = 16
#: Windows of a text that are looked at at once.
PIECE = 1 << 20

_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
ROWS = "digest binary, place int, low int, high int, whole binary, digit bigint"
FOUND = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType())])

Row = tuple[int, int, int, bytes, int]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    size = PIECE + 2 * WINDOW + 1
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each place; it only chooses, so it need not be strong."""
    up, down = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * down[:len(raw) - gram + 1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: of blocks from the left and from the right."""
    size = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:size], left[width - 1:width - 1 + size])


def anchored(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """Runs of neighbouring windows with the same least gram: its place, and the first and last start."""
    data = np.frombuffer(raw, np.uint8)
    for first in range(0, len(raw) - window + 1, PIECE):
        part = data[first:first + PIECE + window - 1]
        hashes = _gram_hashes(part, gram)
        ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(ranked, window - gram + 1) & _PLACE).astype(np.int64) + first
        cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
        starts = np.concatenate(([0], cuts))
        ends = np.concatenate((cuts, [len(place)])) - 1
        yield from zip(place[starts].tolist(), (starts + first).tolist(), (ends + first).tolist())


def _digit(raw: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63)


def first_rows(raw: bytes, window: int = WINDOW) -> Iterator[Row]:
    """First digit: every run of a text, its distances to the gram, its own bytes and the gram."""
    for place, start, last in anchored(raw, window):
        yield place, place - last, place - start, xxhash.xxh3_128_digest(raw[start:last + window]), _digit(raw[place:place + GRAM])


def step_rows(raw: bytes, place: int, low: int, high: int, window: int = WINDOW) -> Iterator[Row]:
    """Next digit: the steps of an open run, and the bytes that all windows of a step share."""
    for at in range(low // STEP * STEP, high + 1, STEP):
        a, b = max(low, at), min(high, at + STEP - 1)
        shared = raw[place - at:place - at - STEP + 1 + window]
        yield place, a, b, xxhash.xxh3_128_digest(raw[place - b:place - a + window]), _digit(shared, at)


def last_rows(raw: bytes, place: int, low: int, high: int, window: int = WINDOW) -> Iterator[Row]:
    """Last digit: single windows."""
    for at in range(low, high + 1):
        yield place, at, at, xxhash.xxh3_128_digest(raw[place - at:place - at + window]), 0


def _batch(digests: list[bytes], rows: list[Row]) -> pa.RecordBatch:
    place, low, high, whole, digit = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(digests, pa.binary()), *(pa.array(c, pa.int32()) for c in (place, low, high)),
        pa.array(whole, pa.binary()), pa.array(digit, pa.int64())],
        names=["digest", "place", "low", "high", "whole", "digit"])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: a batch's texts are not all held as objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _cut(texts: DataFrame, rows_of: Callable[[bytes, list | None], Iterator[Row]], copies: int) -> DataFrame:
    """Rows of texts (digest, compressed text, and the open rows of the text if there is a third column).

    A task cuts up so many copies of a text at most: whether something stands there once or
    more than once is all that counts.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[bytes] = Counter()
        for batch in _parts(batches):
            digests, rows = [], []
            opened = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for digest, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), opened):
                met[digest] += 1
                if met[digest] > copies:
                    continue
                before = len(rows)
                rows.extend(rows_of(zstandard.decompress(text), own))
                digests.extend([digest] * (len(rows) - before))
                if len(rows) > 20_000:
                    yield _batch(digests, rows)
                    digests, rows = [], []
            if rows:
                yield _batch(digests, rows)

    return texts.mapInArrow(cut, ROWS)


def _packed(texts: DataFrame) -> DataFrame:
    """The last column, a text, compressed; a null stays one."""
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField(texts.columns[-1], T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in _parts(batches):
            made = [None if t is None else compress(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=schema.names)

    return texts.mapInArrow(pack, schema)


def _more_than_once(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") > 1).select(column)


def sorted_out(rows: DataFrame, window: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of a pass's rows the spans that are repeated as a whole, and what the next pass has to sort.

    That is every row that shares its digit but is not repeated as a whole, and one row of
    each repeated whole that has the same digit as such a row.
    """
    if last:
        twice = rows.join(stage(_more_than_once(rows, "whole"), "suffix-whole"), "whole", "left_semi")
        return _spans(twice, window), None
    shared = stage(rows.join(stage(_more_than_once(rows, "digit"), "suffix-digits"), "digit", "left_semi"), "suffix-shared")
    whole = stage(_more_than_once(shared, "whole").withColumn("repeated", F.lit(True)), "suffix-whole")
    marked = stage(shared.join(whole, "whole", "left"), "suffix-marked")
    repeated, partly = marked.where(F.col("repeated")), marked.where(F.col("repeated").isNull())
    place = ("digest", "place", "low", "high")
    beside = repeated.join(stage(partly.select("digit").distinct(), "suffix-open"), "digit", "left_semi")
    one = beside.groupBy("whole").agg(F.min(F.struct(*place)).alias("one")).select("one.*")
    return _spans(repeated, window), partly.select(*place).unionByName(one)


def _spans(rows: DataFrame, window: int) -> DataFrame:
    """Spans of the texts, each once; copies of a text have the same ones."""
    return rows.select(
        "digest", (F.col("place") - F.col("high")).alias("first"),
        (F.col("place") - F.col("low") + window).alias("end")).distinct()


def repeated_spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of compressed texts (digest, text; one row per document, none shorter than a window) the spans (digest, first, end) of windows that start twice or more."""
    if window < 2 * GRAM:
        raise ValueError(f"windows have at least {2 * GRAM} bytes")
    spark = texts.sparkSession
    spans, opened = None, None
    for rows_of in (None, step_rows, last_rows):
        found_path, open_path = scratch_path(spark, "suffix-spans"), scratch_path(spark, "suffix-opened")
        with scratch_scope(spark):
            if rows_of is None:
                cut = _cut(texts, lambda raw, _: first_rows(raw, window), 2)
            else:
                def finer(raw: bytes, own: list, rows_of=rows_of) -> Iterator[Row]:
                    for r in own:
                        yield from rows_of(raw, r["place"], r["low"], r["high"], window)

                own = opened.groupBy("digest").agg(F.collect_list(F.struct("place", "low", "high")).alias("opened"))
                cut = _cut(texts.join(own, "digest").select("digest", "text", "opened"), finer, 1)
            found, left = sorted_out(stage(cut, "suffix-rows"), window, rows_of is last_rows)
            found = write_stage(found, found_path)
            opened = left and write_stage(left, open_path)
        spans = found if spans is None else spans.unionByName(found)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add n_bytes, spans (first, end; maximal runs of removed bytes) and kept, the bytes that remain.

    A byte goes if some ``window`` bytes around it also start at another place of any
    document, the same one included; where they overlap counts too. All occurrences go, as
    windows are judged on the input. Null and empty texts and those shorter than a window
    keep all. Columns of these names are replaced, others kept; repeated rows are documents
    of their own, so a long text that stands twice goes whole. Texts and spans are written to
    scratch at once; the texts are cleaned when the result is read.
    """
    spark = docs.sparkSession
    added = [f.name for f in FOUND]
    kept = [c for c in docs.columns if c not in added]
    others = [c for c in kept if c != text]
    content = F.col(f"`{text}`").cast("string")
    digest = F.unhex(F.md5(content.cast("binary")))
    stored = stage(_packed(docs.select(
        digest.alias("__digest"), F.struct(F.lit(True).alias("__"), *(F.col(f"`{c}`") for c in others)).alias("__row"),
        F.octet_length(content).alias("__size"), content.alias("__text"))), "suffix-docs")
    own_path = scratch_path(spark, "suffix-spans")
    with scratch_scope(spark):
        long = stored.where(F.col("__size") >= window).select(F.col("__digest").alias("digest"), F.col("__text").alias("text"))
        own = write_stage(repeated_spans(long, window).groupBy(F.col("digest").alias("__digest")).agg(
            F.collect_list(F.struct("first", "end")).alias("__spans")), own_path)
    return _cleaned(stored.join(own, "__digest", "left"), text).select(*(F.col(f"`{c}`") for c in (*kept, *added)))


def _cleaned(rows: DataFrame, text: str) -> DataFrame:
    schema = T.StructType([*rows.schema["__row"].dataType.fields, T.StructField(text, T.StringType()), *FOUND])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts, sizes, spans, left = [], [], [], []
            for packed, own in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()):
                raw = b"" if packed is None else zstandard.decompress(packed)
                gone = merged([(s["first"], s["end"]) for s in own or ()])
                edges = [0, *(x for span in gone for x in span), len(raw)]
                texts.append(None if packed is None else raw.decode())
                sizes.append(len(raw))
                spans.append([{"first": a, "end": b} for a, b in gone])
                left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [*batch.column("__row").flatten(), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), spans,
                 pa.array(left, pa.binary())], names=schema.names)

    return rows.select("__row", "__text", "__spans").mapInArrow(clean, schema)
