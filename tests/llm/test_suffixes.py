"""Repeated byte windows against a table of all windows."""

import random
from collections import Counter

import pytest

from faultline.llm import suffixes


def _brute(texts, window):
    """Spans to remove per text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    return [
        suffixes.merged([(i, i + window) for i in range(len(r) - window + 1) if seen[r[i:i + window]] > 1])
        for r in raws]


def _check(spark, texts, window, parts=3):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id int, text string, kept string, low int")
    rows = suffixes.without_repeats(docs.repartition(parts), window=window).collect()
    want = _brute(texts, window)
    assert len(rows) == len(texts)
    for r in rows:
        raw, spans = (texts[r["doc_id"]] or "").encode(), want[r["doc_id"]]
        assert [tuple(s) for s in r["spans"]] == spans, r["doc_id"]
        assert r["n_bytes"] == len(raw) and r["low"] == 5
        gone = {i for a, b in spans for i in range(a, b)}
        assert bytes(r["kept"]) == bytes(x for i, x in enumerate(raw) if i not in gone)
    return want


def _prose(draw, n):
    return " ".join("".join(draw.choices("abcdefghiéü", k=draw.randrange(2, 9))) for _ in range(n))


def test_passages_copies_and_ends(spark):
    draw = random.Random(5)
    passages = [_prose(draw, n) for n in (20, 26, 27, 40, 200)]
    texts = [_prose(draw, draw.randrange(5, 150)) for _ in range(30)]
    for _ in range(30):
        cut = draw.choice(passages)
        a = draw.randrange(len(cut) // 3)
        texts.append(_prose(draw, draw.randrange(30)) + cut[a:len(cut) - draw.randrange(len(cut) // 3)] + _prose(draw, draw.randrange(30)))
    texts += [texts[3], texts[3], texts[40], None, "", "short", passages[4] * 2, passages[4][:160], passages[4][:160]]
    want = _check(spark, texts, 160)
    assert 15 < sum(bool(w) for w in want) < len(texts)


def test_a_run_shared_by_copies_and_by_the_end_of_another_text(spark):
    """The copies are repeated as a whole at once; a third text holds only a part of their run."""
    draw = random.Random(6)
    for size in (128, 140, 200):
        copy = _prose(draw, 120)
        texts = [copy, copy, *(_prose(draw, 9) + copy[a:a + size + 7] + _prose(draw, 9) for a in (0, 31, 150))]
        want = _check(spark, texts, 128, parts=1)
        assert all(want)


def test_texts_of_few_letters(spark):
    draw = random.Random(7)
    texts = ["a" * 700, "ab" * 300, "a" * 128, "a" * 127, "abc" * 100 + "x" + "abc" * 100]
    texts += ["".join(draw.choices("ab", k=400)) * draw.randrange(1, 3) for _ in range(6)]
    _check(spark, texts, 128)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1_000)
    suffixes._powers.cache_clear()
    draw = random.Random(9)
    long = _prose(draw, 3_000)
    whole = [(p, s, e) for p, s, e in suffixes.anchored(long.encode(), 128)]
    assert [s for _, s, _ in whole[1:]] == [e + 1 for _, _, e in whole[:-1]] and whole[-1][2] == len(long.encode()) - 128
    assert all(s <= p <= s + 64 for p, a, b in whole for s in (a, b))
    suffixes._powers.cache_clear()
    monkeypatch.undo()
    _check(spark, [long, _prose(draw, 50) + long[4_000:9_000], _prose(draw, 20)], 128)


def test_empty_table_and_window_bound(spark):
    docs = spark.createDataFrame([(1, "a" * 500)], "doc_id int, text string")
    assert suffixes.without_repeats(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        suffixes.without_repeats(docs, window=100)
