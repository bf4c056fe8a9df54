"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import pytest

from faultline.llm import runs
from faultline.llm.queries import QUERIES


def _brute(w):
    """All maximal stretches at least twelve words and two smallest periods long."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        same = [w[i] == w[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                part = w[i:j + q]
                if not any(all(part[x] == part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                    out.add((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _planted(doc_id, text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_all_maximal_stretches(letters):
    draw = random.Random(letters)
    for size in (0, 1, 2, 11, 12, 13, 25, 40, 90):
        for _ in range(12):
            w = [b"%d" % draw.randrange(letters) for _ in range(size)]
            if draw.random() < 0.5 and size > 20:
                part = w[:draw.randint(1, 9)]
                w[5:5] = part * draw.randint(2, 5)
            found = runs.runs(w)
            assert found == _brute(w), w
            assert runs.collapsed(w, found).decode() == _collapsed([x.decode() for x in w], found)


def test_shapes_with_many_squares():
    a, b = b"a", b"b"
    fib = [[a], [a, b]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    for w in (fib[-1], [a] * 150, ([a] * 7 + [b]) * 20, [b"x%d" % (i % 37) for i in range(180)], [b"%d" % (i * i % 24) for i in range(160)]):
        assert runs.runs(w) == _brute(w)


def test_covered_stretches_leave_unrepeated_text_out():
    w = [b"w%d" % i for i in range(5_000)]
    assert runs.covered(w) == []
    w[1_000:1_000] = [b"p", b"q", b"r"] * 6
    assert runs.covered(w) == [(1_000, 1_018)]
    assert runs.runs(w) == [(1_000, 18, 3)]


def test_long_periodic_text():
    w = [b"%d" % (i % 7_001) for i in range(40_000)] + [b"a"] * 60_000
    assert runs.runs(w) == [(0, 40_000, 7_001), (40_000, 60_000, 1)]


def test_rows_that_are_odd(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "ha " * 12, 9), (4, "ha " * 12, 9), (None, "a b\x0bc", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.with_runs(docs).collect()]
    assert got == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 1)], "ha"), (4, 12, [(0, 12, 1)], "ha"),
                   (None, 2, [], "a b c")]


def test_query(spark, sf):
    rows = QUERIES["op13_periodic_runs"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and sum(r["n_runs"] > 0 for r in rows) > 10
    for r in rows:
        w = _planted(r["doc_id"], texts[r["doc_id"]])
        if len(w) > 900:
            found = runs.runs([x.encode() for x in w])
        else:
            found = _brute(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want = (len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_collapsed(w, found).encode()).hexdigest())
        assert tuple(r)[1:] == want, r["doc_id"]
