"""Both similarity joins against all pairs."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from faultline.llm import blocks, embeddings, ngram_join
from faultline.llm.queries import QUERIES


def _groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _expected(ids, pairs):
    """Links and smallest reachable id of each position."""
    links = [0] * len(ids)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    groups = _groups(len(ids), pairs)
    least = {}
    for x, g in enumerate(groups):
        least[g] = min((i for i in (least.get(g), ids[x]) if i is not None), default=None)
    return [(ids[x], links[x], least[g]) for x, g in enumerate(groups)]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def _text_pairs(texts):
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return [
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def _words(draw, n):
    return [f"w{draw.randrange(4000)}é" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(12)
    out = [" ".join(_words(draw, draw.randrange(3, 120))) for _ in range(60)]
    passage = " ".join(_words(draw, 60))
    out += [f"{' '.join(_words(draw, 40))} {passage} {' '.join(_words(draw, 40))}" for _ in range(40)]
    base = _words(draw, 200)
    for k in range(90):  # near copies of one text: more than a block holds in the test below
        copy = list(base)
        copy[draw.randrange(200)] = f"edit{k}"
        out.append(" ".join(copy))
    edge = _words(draw, 84)  # eighty shingles: a change at the end loses some, around the threshold
    out += [" ".join(edge[:84 - k]) for k in range(0, 24, 2)]
    out += [out[0]] * 30 + [out[1].upper() + "!"] + [None, "", "...", None, "", "two words", "Two, words?", "x"]
    out += [" ".join(_words(draw, 30_000))] * 2
    return out


@pytest.mark.parametrize("block_rows", [512, 16])
def test_ngram_join(spark, texts, block_rows, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    ids = [1000 - k for k in range(len(texts))]
    ids[3], ids[100], ids[101] = None, 2, 2
    docs = spark.createDataFrame(
        list(zip(ids, texts, ["own"] * len(ids))), "doc_id bigint, text string, content string").repartition(5)
    found = ngram_join.joined(docs.select("doc_id", "text"))
    got = [(r["id"], r["n_links"], r["component_rep"]) for r in found.collect()]
    assert _sorted(got) == _sorted(_expected(ids, _text_pairs(texts)))


def test_kept_rows(spark, texts):
    ids = list(range(len(texts)))
    rows = list(zip(ids, texts, ids)) + [(0, texts[0], 0), (0, texts[0], -1), (5, "another text with the same id", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, content int")
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    stands = {(i, t) for (i, _, least), t in zip(_expected(ids, _text_pairs(texts)), texts) if i == least}
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(stands | {(5, "another text with the same id")}, key=str)


def test_ngram_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.joined(none).count() == 0 and ngram_join.without_near_copies(none).count() == 0
    wordless = spark.createDataFrame([(1, None), (2, ""), (3, "--")], "doc_id bigint, text string")
    assert [r["n_links"] for r in ngram_join.joined(wordless).collect()] == [0, 0, 0]
    assert ngram_join.without_near_copies(wordless).count() == 3


def test_pruning_keeps_what_may_reach_the_threshold():
    for values in (16, 32, 48, 64):
        m = ngram_join.needed(values)
        draws = np.random.default_rng(1).beta([m + 1, m], [values - m + 1, values - m + 2], (200_000, 2))
        assert (draws[:, 1] >= 0.8).mean() < 1e-4 and m > 0.2 * values


def test_ngram_query_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = _expected([r["doc_id"] for r in rows], _text_pairs([r["text"] for r in rows]))
    got = [(r["doc_id"], r["n_links"], r["component_id"]) for r in QUERIES["op5_ngram_jaccard_join"](spark, sf).collect()]
    assert _sorted(got) == _sorted(want)


def test_runs_cross_batches():
    frames = [pd.DataFrame({"key": k, "lo": 0, "hi": 0, "x": x}) for k, x in (
        ([1, 1, 2], [1, 2, 3]), ([2], [4]), ([], []), ([2, 3, 3], [5, 6, 7]), ([4], [8]))]
    runs = [f["x"].tolist() for f in blocks.sorted_runs(iter(frames), blocks.GROUP)]
    assert runs == [[1, 2], [3, 4, 5], [6, 7], [8]]


def _vector_pairs(vectors):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    units = [np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max()) if u else None for v, u in zip(vectors, usable)]
    return [
        (a, b) for a in range(len(vectors)) for b in range(a + 1, len(vectors))
        if usable[a] and usable[b] and len(vectors[a]) == len(vectors[b]) and units[a] @ units[b] >= 0.9]


@pytest.mark.parametrize("block_rows", [512, 16])
def test_embedding_join(spark, block_rows, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    draw = np.random.default_rng(4)
    vectors = [draw.normal(size=32).tolist() for _ in range(150)]
    hot = draw.normal(size=32)
    vectors += [(hot + 0.1 * draw.normal(size=32)).tolist() for _ in range(120)]
    vectors += [(np.array(vectors[k]) + 0.2 * draw.normal(size=32)).tolist() for k in range(60)]
    vectors += [vectors[0]] * 20 + [[3 * x for x in vectors[1]], [-x for x in vectors[2]], [1e300 * x for x in vectors[3]]]
    vectors += [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [1.0], [2.0], [1.0, 0.0], [1.0, 0.1], [5.0] * 7]
    ids = [5000 - k for k in range(len(vectors))]
    ids[7] = None
    rows = spark.createDataFrame(
        list(zip(ids, vectors, range(len(ids)))), "vec_id bigint, embedding array<double>, links int").repartition(3)
    got = [(r["id"], r["n_links"], r["component_rep"]) for r in embeddings.joined(rows).collect()]
    want = _expected(ids, _vector_pairs(vectors))
    assert _sorted(got) == _sorted(want)


def test_embedding_join_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.joined(none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0.0]), (3, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r["id"], r["n_links"], r["component_rep"]) for r in embeddings.joined(odd).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_bits_are_balanced_and_rotations_differ():
    sample = embeddings.unit(np.random.default_rng(2).normal(size=(2000, 24)) + 0.5)
    directions, medians = embeddings.rotations(sample, 96)
    share = (sample @ directions > medians).mean(axis=0)
    assert directions.shape == (24, 96) and np.abs(share - 0.5).max() < 0.01
    assert np.abs(directions[:, :24].T @ directions[:, 24:48]).max() < 0.999


def test_embedding_recall_on_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = _expected([r["vec_id"] for r in rows], _vector_pairs([list(r["embedding"]) for r in rows]))
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in QUERIES["op1_embedding_near_dedup"](spark, sf).collect()]
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    assert _sorted(got) == _sorted(want)
