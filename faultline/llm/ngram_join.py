"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of five-word shingles. Equal sets are one class. Classes that agree on a
band of MinHash values are candidates; their values are compared a few at a time, and a pair
goes as soon as the posterior probability that its similarity reaches the threshold, given
the agreements so far and a flat prior, is below ``TOLERANCE``. What is left is verified on
the shingle sets themselves, made anew from the texts.

With 16 bands of 4 values a pair at similarity 0.8 has no band in common with probability
2e-4, at 0.9 with 2e-8; the tolerance adds less than that.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.blocks import Method, Pairs, linked_classes, with_links
from faultline.session import scratch_path, scratch_scope
from faultline.sources.tables import stage, write_stage

WORDS, THRESHOLD = 5, (4, 5)
BANDS, BAND_VALUES, STEP = 16, 4, 16
VALUES = BANDS * BAND_VALUES
TOLERANCE = 1e-7

_WORD = re.compile(r"\w+")
_KNOWN: dict[str, int] = {}
_KNOWN_WORDS = 200_000


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; the table of known ones is emptied when it is full."""
    known = _KNOWN
    if len(known) > _KNOWN_WORDS:
        known.clear()
    for word in set(words).difference(known):
        known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word windows; a shorter text is one window, one without words none."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = _word_hashes(words)
    width_here = min(width, len(words))
    out = np.zeros(len(words) - width_here + 1, np.uint64)
    for k in range(width_here):
        out = _mixed(out + hashes[k:k + len(out)] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return (
        draw.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        draw.integers(0, 1 << 63, VALUES, dtype=np.uint64))


_FACTORS, _SHIFTS = _constants()


def minhash(hashes: np.ndarray) -> np.ndarray:
    """``VALUES`` MinHash values of 32 bits, a thousand shingles at a time."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        part = hashes[start:start + 1024, None] * _FACTORS
        part += _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


@lru_cache
def needed(values: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> int:
    """Agreements among so many values from which a pair stays.

    With a flat prior the similarity's posterior is Beta(m + 1, n - m + 1), and its upper tail
    at the threshold is the probability that Binomial(n + 1, threshold) is at most m.
    """
    tail = 0.0
    for m in range(values + 1):
        tail += math.comb(values + 1, m) * threshold ** m * (1 - threshold) ** (values + 1 - m)
        if tail >= tolerance:
            return m
    return values


def screen(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> Pairs:
    """Compare MinHash values incrementally and drop pairs by their posterior; then pairs of earlier bands."""
    left, right = left.view("<u4"), right.view("<u4")
    met = np.zeros(len(i), np.int16)
    for start in range(0, VALUES, STEP):
        stop = start + STEP
        met = met + (left[i, start:stop] == right[j, start:stop]).sum(axis=1)
        stay = met >= needed(stop)
        i, j, met = i[stay], j[stay], met[stay]
    for band in range(table):
        part = slice(band * BAND_VALUES, (band + 1) * BAND_VALUES)
        stay = (left[i, part] != right[j, part]).any(axis=1)
        i, j = i[stay], j[stay]
    return i, j


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    order = np.cumsum(shared) - 1
    keep = shared[column]
    owners, column = owners[keep], order[column[keep]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    by_column = np.argsort(column, kind="stable")
    owners, column = owners[by_column], column[by_column]
    width = 8192
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owners[a:b], column[a:b] - start] = 1
        common += part @ part.T
    return common[i, j].astype(np.int64)


def verify(left: list[bytes], right: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact similarity of the shingle sets of two lists of texts, in whole numbers."""
    same = left is right or left == right
    wanted = sorted(set(i.tolist()) | (set(j.tolist()) if same else set()))
    place = {x: k for k, x in enumerate(wanted)}
    sets = [shingles(left[x].decode()) for x in wanted]
    a = np.array([place[x] for x in i.tolist()])
    if same:
        b = np.array([place[x] for x in j.tolist()])
    else:
        others = sorted(set(j.tolist()))
        place = {x: k + len(sets) for k, x in enumerate(others)}
        sets += [shingles(right[x].decode()) for x in others]
        b = np.array([place[x] for x in j.tolist()])
    size = np.array([len(s) for s in sets], np.int64)
    common = _common(sets, a, b)
    return common * THRESHOLD[1] >= (size[a] + size[b] - common) * THRESHOLD[0]


METHOD = Method(screen, verify)


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, mark (hash of the text), content (digest of the shingle set, null without words), sketch. Written once."""
    @F.pandas_udf("content string, sketch binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = shingles(text)
            rows.append((
                hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest(), minhash(found).tobytes())
                if len(found) else (None, None))
        return pd.DataFrame(rows, columns=["content", "sketch"])

    rows = docs.select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), sketch(F.col(text)).alias("made"))
    return stage(rows.select("id", "mark", "made.content", "made.sketch"), "ngram-sketches")


def _first(*others: str) -> Column:
    """The smallest id, a null one last, with other columns of its row."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", *others))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, mark, content, rep, n_links, component_rep, cid, component.

    ``rep`` is the smallest id with an equal shingle set, ``n_links`` the number of other rows
    of similarity 0.8 or more, ``component_rep`` the smallest id that links reach. Rows without
    words (null and empty texts too) link with nothing and stand for themselves. Repeated
    rows are rows of their own. A row with a null id takes part; it is nobody's ``rep`` unless
    all ids of its class are null.
    """
    path = scratch_path(docs.sparkSession, "ngram-joined")
    with scratch_scope(docs.sparkSession):
        return write_stage(_joined(docs, key, text), path)


def _joined(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = sketched(docs, key, text)
    classes = rows.where(F.col("content").isNotNull()).groupBy("content").agg(
        _first("mark").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    classes = stage(classes.select(
        "content", F.col("row.id").alias("rep"), F.col("row.mark").alias("mark"), "copies", "sketch",
        F.monotonically_increasing_id().alias("cid")), "ngram-classes")
    keys = classes.select("cid", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("table")).select(
        "cid", "table", F.xxhash64("table", F.substring(
            F.col("sketch"), F.col("table") * (4 * BAND_VALUES) + 1, F.lit(4 * BAND_VALUES))).alias("key"))
    texts = docs.where(F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("text_mark"), F.col(text).cast("binary").alias("payload"))

    def payloads(survivors: DataFrame) -> DataFrame:
        met = survivors.join(classes.select("cid", "rep", "mark"), "cid")
        return met.join(texts, (F.col("mark") == F.col("text_mark")) & F.col("rep").eqNullSafe(F.col("id"))).select(
            *survivors.columns, "payload")

    linked = linked_classes(classes, keys, payloads, METHOD)
    return with_links(rows.drop("sketch"), classes.drop("mark"), linked, F.col("id"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id; all rows without words stay.

    Rows that repeat the kept one leave one. Columns and their values are kept.
    """
    found = joined(docs, key, text)
    worded = found.where(F.col("content").isNotNull())
    first = worded.groupBy("component").agg(_first("mark").alias("row")).select("component", "row.id", "row.mark")
    same = worded.join(
        first.select(F.col("component").alias("c"), F.col("id").alias("i"), F.col("mark").alias("m")),
        (F.col("component") == F.col("c")) & (F.col("mark") == F.col("m")) & F.col("id").eqNullSafe(F.col("i")))
    marks = same.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("rows")).unionByName(
        found.where(F.col("content").isNull()).select("id", "mark").distinct().withColumn("rows", F.lit(0).cast("bigint")))
    marks = stage(marks.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("rows").alias("_rows")), "ngram-kept")
    rows = docs.join(marks, (F.xxhash64(text) == F.col("_mark")) & F.col(key).cast("bigint").eqNullSafe(F.col("_id")))
    order = Window.partitionBy("_id", "_mark").orderBy(*docs.columns)
    again = rows.where(F.col("_rows") > 1).withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1)
    return rows.where(F.col("_rows") <= 1).select(*docs.columns).unionByName(again.select(*docs.columns))
