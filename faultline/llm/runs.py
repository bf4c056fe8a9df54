"""Periodic runs of words: a suffix automaton whose link paths are recoloured by last occurrence.

A run is a stretch of words with smallest period q, at least ``2 * q`` and ``MIN_LENGTH``
words long, that no neighbouring word extends with the same period.

1. Every word of a run stands in a ``GRAM``-word gram that its text repeats: the stretch
   without its last period and the one without its first are copies, ``GRAM`` words long at
   least, and cover the run together. So only the stretches covered by repeated grams are
   searched; grams are compared by hash, and an equal hash of different grams only makes a
   stretch longer than needed.
2. Such a stretch goes into a suffix automaton. Then its prefixes are taken in order, and
   each accesses the path from its state to the root of the link tree, as a link-cut tree
   does: the path takes the prefix's end as its colour. What was there are segments that
   ended last at an earlier place e; a segment with strings up to L words whose distance
   ``d = end - e`` is at most L is a square of period d. For the smallest period L is the
   whole common past of both ends, so the run starts at ``e - L + 1``, and it ends at the
   last prefix that reports it.

The tree does not change while it is accessed, so its preferred paths are kept as stacks of
(longest string, last end) on heavy paths: n words cost O(n log n) segments.

A text is one row of one task and nothing is shuffled. Memory goes by the longest covered
stretch of a text, some 700 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

MIN_LENGTH = 12
GRAM = 6

Run = tuple[int, int, int]
RUNS_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType()),
])


def words(text: str | None) -> list[bytes]:
    """The maximal matches of ``[^\\x20\\x09-\\x0D]+``, which is how bytes split."""
    return text.encode().split() if text else []


def covered(tokens: list[bytes]) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least ``MIN_LENGTH`` words covered by grams that occur twice."""
    size = len(tokens) - GRAM + 1
    if size < 2 or len(tokens) < MIN_LENGTH:
        return []
    ids = np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)
    grams = np.zeros(size, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + size]
        grams ^= grams >> np.uint64(29)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(grams, twice))
    cuts = np.flatnonzero(np.diff(at) > GRAM)
    starts, ends = at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))] + GRAM
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= MIN_LENGTH]


class Automaton:
    """Suffix automaton of a word sequence: per state its longest string, its link, and the state of each prefix."""

    def __init__(self, ids: list[int]):
        self.length, self.link, self.prefix = length, link, prefix = [0], [-1], []
        following: list[dict[int, int]] = [{}]
        last = 0
        for word in ids:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            following.append({})
            prefix.append(state)
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = state
                at = link[at]
            if at >= 0:
                target = following[at][word]
                if length[target] == length[at] + 1:
                    link[state] = target
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[target])
                    following.append(following[target].copy())
                    while at >= 0 and following[at].get(word) == target:
                        following[at][word] = copy
                        at = link[at]
                    link[target] = link[state] = copy
            last = state

    def heads(self) -> list[int]:
        """The top of each state's heavy path in the link tree."""
        length, link = self.length, self.link
        order = sorted(range(1, len(length)), key=length.__getitem__)
        size, heavy = [1] * len(length), [0] * len(length)
        for state in reversed(order):
            size[link[state]] += size[state]
        for state in order:
            rival = heavy[link[state]]
            if not rival or size[state] > size[rival]:
                heavy[link[state]] = state
        head = list(range(len(length)))
        for state in order:
            if heavy[link[state]] == state:
                head[state] = head[link[state]]
        return head


def squares(ids: list[int]) -> list[Run]:
    """All maximal stretches at least two smallest periods long, as (start, length, period)."""
    automaton = Automaton(ids)
    length, link, head = automaton.length, automaton.link, automaton.heads()
    paths: dict[int, list[tuple[int, int]]] = {}
    ends: dict[tuple[int, int], int] = {}
    for end, state in enumerate(automaton.prefix):
        found: dict[int, int] = {}
        while state > 0:
            top, reach = head[state], length[state]
            path = paths.setdefault(top, [])
            seen = 0
            while path and path[-1][0] <= reach:
                seen, before = path.pop()
                if end - before <= seen and found.get(before, 0) < seen:
                    found[before] = seen
            if path and seen < reach:
                before = path[-1][1]
                if end - before <= reach and found.get(before, 0) < reach:
                    found[before] = reach
            path.append((reach, end))
            state = link[top]
        for before, common in found.items():
            ends[before - common + 1, end - before] = end
    return [(start, end - start + 1, period) for (start, period), end in ends.items()]


def runs(tokens: list[bytes]) -> list[Run]:
    """The runs of a text by start, then period."""
    out = []
    for first, last in covered(tokens):
        known: dict[bytes, int] = {}
        ids = [known.setdefault(w, len(known)) for w in tokens[first:last]]
        out += [(first + start, size, period) for start, size, period in squares(ids) if size >= MIN_LENGTH]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(tokens: list[bytes], found: list[Run]) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if found:
        edges = np.zeros(len(tokens) + 1, np.int64)
        for start, size, period in found:
            edges[start + period] += 1
            edges[start + size] -= 1
        tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(tokens)


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, runs (start, length, period; by start, then period) and collapsed.

    ``collapsed`` is the text with every run cut to its first period, its words joined by one
    space. Null and empty texts have no words, no runs and an empty collapsed text. Columns
    of these names are replaced, others kept; repeated rows are texts of their own.
    """
    added = [f.name for f in RUNS_SCHEMA]
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *RUNS_SCHEMA])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(RUNS_SCHEMA)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = []
            for t in batch.column(len(kept)).to_pylist():
                tokens = words(t)
                own = runs(tokens)
                made.append((
                    len(tokens), [{"start": s, "length": n, "period": q} for s, n, q in own],
                    collapsed(tokens, own).decode()))
            columns = [pa.array(column, f.type) for column, f in zip(zip(*made), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return rows.mapInArrow(found, schema)


def longest(found: str = "runs") -> Column:
    """The longest run; of equal ones that with the smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(found, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct(
        (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_planted_tail(text: Column, key: Column) -> Column:
    """The text, or for a tenth of the keys its words with a periodic tail put in, joined by one space.

    By ``h = crc32(key)`` and ``g = h div 10``: where h is a multiple of ten, each word i from
    ``a = g mod n`` on becomes word ``a + (i - a) mod p``, ``p = 1 + (n - a) div (3 + g mod 8)``.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def tailed(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        # One value in an array binds it to a name, so that no word computes it again.
        return F.element_at(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda s: F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < s["a"], i).otherwise(
                s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))), " ")), 1)

    split = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    planted = F.element_at(F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, tailed(w)).otherwise("")), 1)
    return F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(text)
