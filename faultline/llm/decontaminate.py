"""Benchmark decontamination: test windows in a broadcast hash set, scanned over training texts.

The benchmark is the side with a bound: its characters are counted before anything is
collected. Up to ``INDEX_CHARS`` of them are broadcast as one buffer of words; a worker keeps
the windows as sorted 64-bit hashes with places in that buffer, at most some 60 bytes a word
while it sorts them, so under 130 MB for a slice of one-letter words. Equal windows are kept once,
with the items that hold them, so a hit is compared once however often its window occurs in the
benchmark. Beyond the bound the items
are dealt by hash into slices. Each slice is a scan and a job of its own, and its broadcast goes
when the job has ended, so a larger benchmark costs time and no memory.

Texts stay where they are for one slice. For several the rows are written once with a number,
the slices' hits are merged by it, and texts move only if the hits are too many to broadcast.
A window is found by its hash and then compared word by word, so a collision adds nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from faultline.sources.tables import stage

WINDOW = 10
INDEX_CHARS = 4_000_000

#: Fixed value of the contract: what a word is, once A-Z are lower-cased. On UTF-8 bytes, of
#: which ``lower`` changes A-Z only, it finds the same words as on characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCAN_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def _hashes(found: list[bytes]) -> np.ndarray:
    """Hashes of words, the same within one process only."""
    return np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)


def _mixed(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words."""
    size = len(hashes) - width + 1
    out = np.zeros(size, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + size]
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The windows of a bounded set of items. What travels is the words; hashes are made where they are used."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width = width
        self.items = [item for item, _ in items]
        found = [words(text) for _, text in items]
        self.first = np.cumsum([0, *map(len, found)])
        flat = [w for own in found for w in own]
        self.buffer = b" ".join(flat)
        self.ends = np.cumsum([len(w) + 1 for w in flat], dtype=np.int64) - 1

    @classmethod
    def of(cls, items: list[tuple[str, str]], width: int) -> "Index":
        return cls(items, width)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "windows"}

    def text(self, place: int, width: int) -> bytes:
        """The words from a place on; none holds a space."""
        start = int(self.ends[place - 1]) + 1 if place else 0
        return self.buffer[start:int(self.ends[place + width - 1])]

    @cached_property
    def windows(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By width the sorted hashes of the distinct windows, a place of each in the words, and the numbers of its items from where to where."""
        hashes = _hashes(self.buffer.split(b" ")) if len(self.ends) else np.zeros(0, np.uint64)
        sizes = np.minimum(np.diff(self.first), self.width)
        out = {}
        for width in np.unique(sizes[sizes > 0]).tolist():
            inside = np.zeros(len(hashes) - width + 1, bool)
            for item in np.flatnonzero(sizes == width):
                inside[self.first[item]:self.first[item + 1] - width + 1] = True
            places = np.flatnonzero(inside)
            mixed = _mixed(hashes, width)[places]
            order = np.argsort(mixed, kind="stable")
            out[width] = self._distinct(mixed[order], places[order], width)
        return out

    def _distinct(self, mixed: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted windows by their words: hash and place of each, its items' numbers, and the bounds of those."""
        heads = np.concatenate(([True], mixed[1:] != mixed[:-1]))
        bounds = np.append(np.flatnonzero(heads), len(mixed))
        for run in np.flatnonzero(np.diff(bounds) > 1).tolist():
            start, end = int(bounds[run]), int(bounds[run + 1])
            text = self.text(int(places[start]), width)
            if all(self.text(int(p), width) == text for p in places[start + 1:end]):
                continue
            by_text: dict[bytes, list[int]] = {}  # the same hash, other words
            for p in places[start:end].tolist():
                by_text.setdefault(self.text(p, width), []).append(p)
            places[start:end] = [p for own in by_text.values() for p in own]
            heads[start + np.cumsum([0, *map(len, by_text.values())])[:-1]] = True
        holders = (np.searchsorted(self.first, places, side="right") - 1).astype(np.int32)
        new = heads.copy()
        new[1:] |= holders[1:] != holders[:-1]
        bounds = np.append(np.flatnonzero(heads[new]), np.count_nonzero(new))
        return mixed[heads], places[heads], holders[new], bounds

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, the merged runs of hit words (first, last), the items that occur."""
        found = words(text)
        total = len(found)
        hit, items = [], np.zeros(len(self.items), bool)
        hashes = _hashes(found) if total else None
        for width, (wanted, places, holders, bounds) in self.windows.items():
            if width > total:
                continue
            mixed = _mixed(hashes, width)
            at = np.searchsorted(wanted, mixed)
            at[at == len(wanted)] = 0
            met = set()
            for start in np.flatnonzero(wanted[at] == mixed).tolist():
                window, k = b" ".join(found[start:start + width]), int(at[start])
                while k < len(wanted) and wanted[k] == mixed[start]:
                    if self.text(int(places[k]), width) == window:
                        met.add(k)
                        hit.append((start, start + width - 1))
                        break
                    k += 1
            for k in met:
                items[holders[bounds[k]:bounds[k + 1]]] = True
        return total, merged(hit), {self.items[k] for k in np.flatnonzero(items)}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def _slices(benchmark: DataFrame, item: str, text: str) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many slices of at most about ``INDEX_CHARS`` characters there are, and the items of each."""
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, math.ceil(chars / INDEX_CHARS))

    def parts() -> Iterator[list[tuple[str, str]]]:
        for k in range(count):
            part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
            yield [(r["item"], r["text"]) for r in part.toLocalIterator()]

    return count, parts()


def with_hits(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Add n_words, hits and items to every document.

    ``hits`` are the runs of hit words (positions from 0, both ends included), ``items`` the
    sorted ids, as text, of the items of which a window occurs. Null texts have no words, an
    item without words has no window, an item shorter than the window is one window. Items
    with the same id count once. Columns of these names are replaced, others kept.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    names = [F.col(f"`{c}`") for c in kept]
    context = docs.sparkSession.sparkContext
    count, slices = _slices(benchmark, item, item_text)
    if count == 1:
        shared = context.broadcast(Index(next(slices), width))
        return docs.select(*names, _scanner(shared)(F.col(f"`{text}`")).alias("__scan")).select(
            *names, F.col("__scan.n_words").alias("n_words"), F.col("__scan.hits").alias("hits"), F.col("__scan.items").alias("items"))
    rows = stage(docs.select(*names, F.monotonically_increasing_id().alias("__id")), "scanned-rows")
    found = None
    for items in slices:
        shared = context.broadcast(Index(items, width))
        part = rows.select("__id", _scanner(shared)(F.col(f"`{text}`")).alias("__scan"))
        part = stage(part.where(F.size("__scan.hits") > 0).select("__id", "__scan.hits", "__scan.items"), "scanned-slice")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("__id").agg(
        F.flatten(F.collect_list("hits")).alias("__hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    nothing = _scanner(context.broadcast(Index([], width)))
    whole = rows.select("*", nothing(F.col(f"`{text}`")).alias("__scan")).join(stage(found, "scanned-hits"), "__id", "left")
    return whole.select(
        *names, F.col("__scan.n_words").alias("n_words"), _merge(F.coalesce("__hits", F.col("__scan.hits"))).alias("hits"),
        F.coalesce("__items", F.col("__scan.items")).alias("items"))


def _scanner(shared):
    @F.pandas_udf(SCAN_SCHEMA)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.scan(t) for t in texts]
        return pd.DataFrame({
            "n_words": [r[0] for r in rows],
            "hits": [[{"first": a, "last": b} for a, b in r[1]] for r in rows],
            "items": [sorted(r[2]) for r in rows],
        })

    return scanned


def _merge(column: Column) -> Column:
    @F.pandas_udf("array<struct<first:int,last:int>>")
    def joined(runs: pd.Series) -> pd.Series:
        return pd.Series([
            [{"first": a, "last": b} for a, b in merged([(r["first"], r["last"]) for r in row])] for row in runs])

    return joined(column)


def hit_words(hits: str = "hits") -> Column:
    """How many words the runs hold."""
    return F.aggregate(
        F.col(hits), F.lit(0).cast("bigint"), lambda n, r: n + (r["last"] - r["first"] + 1).cast("bigint"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, **names) -> DataFrame:
    """The documents in which no window occurs, with their own columns."""
    found = with_hits(docs, benchmark, width, **names)
    return found.where(F.size("hits") == 0).select(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text: str = "text", **names) -> DataFrame:
    """All documents, the hit words cut out of their texts with what stands between them."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([without_runs(t, [(r["first"], r["last"]) for r in h]) for t, h in zip(texts, hits)], dtype="object")

    found = with_hits(docs, benchmark, width, text=text, **names)
    return found.withColumn(text, cut(F.col(text), F.col("hits"))).select(*docs.columns)


def without_runs(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    if not text or not runs:
        return text
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for first, last in runs:
        out.append(raw[at:spans[first][0]])
        at = spans[last][1]
    return (b"".join(out) + raw[at:]).decode()


def items_digest(items: str = "items") -> Column:
    """Lower-case hex SHA-256 of the comma-joined item ids."""
    return F.sha2(F.array_join(F.col(items), ",").cast("binary"), 256)
