"""Links of vectors close to the threshold: by number of vectors, and where all share a direction."""

import numpy as np
import pytest

from faultline.llm import embeddings

SIZE = 64


def _vectors(draw, count, common):
    """Unit vectors, random ones at a mean cosine of about common ** 2 / (1 + common ** 2)."""
    mean = np.zeros(SIZE)
    mean[0] = common
    return embeddings.unit(draw.normal(size=(count, SIZE)) / SIZE ** 0.5 + mean)


def _partners(draw, vectors):
    """For each vector one at a cosine of 0.90 to 0.92."""
    aside = draw.normal(size=vectors.shape)
    aside = embeddings.unit(aside - (aside * vectors).sum(axis=1, keepdims=True) * vectors)
    near = draw.uniform(0.9001, 0.92, size=(len(vectors), 1))
    return near * vectors + np.sqrt(1 - near ** 2) * aside


def _found(codes, vectors, others):
    """Which pairs share a table and are within the radius."""
    (a, left), (b, right) = codes.of(vectors), codes.of(others)
    near = np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1) <= codes.radius
    return near & (left == right).any(axis=1)


@pytest.mark.parametrize("count, common", [(500, 0.0), (500, 1.0), (100_000, 1.0), (10_000_000, 0.0), (1_000_000, 1.0)])
def test_recall_does_not_fall_with_count(count, common):
    draw = np.random.default_rng(5)
    vectors = _vectors(draw, 2_000, common)
    codes = embeddings.learnt(vectors, count)
    assert codes.bits >= embeddings.LEAST_BITS
    unseen = _vectors(draw, 4_000, common)
    for some in (vectors, unseen):
        assert _found(codes, some, _partners(draw, some)).sum() >= len(some) - 2


def test_clustered_vectors_keep_their_links():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(20, SIZE))
    vectors = embeddings.unit(centres[draw.integers(0, 20, 3_000)] + 0.3 * draw.normal(size=(3_000, SIZE)))
    codes = embeddings.learnt(vectors[:2_000], 50_000)
    assert _found(codes, vectors, _partners(draw, vectors)).sum() >= len(vectors) - 2


def test_tables_follow_the_missed_share():
    shares = [np.full(100, 0.144), np.linspace(0.1, 0.2, 100)]
    for bits in (1, 8, 16, 24):
        tables = embeddings.needed(shares, bits)
        assert max(embeddings.missed(s, bits, tables) for s in shares) <= embeddings.MISS
        assert tables == 1 or max(embeddings.missed(s, bits, tables - 1) for s in shares) > embeddings.MISS


def test_codes_are_balanced_and_of_the_stated_length():
    vectors = _vectors(np.random.default_rng(3), 2_000, 0.5)
    codes = embeddings.learnt(vectors, 100_000)
    signs = codes.signs(vectors)
    assert signs.shape[1] == codes.bits * codes.tables and np.abs(signs.mean(axis=0) - 0.5).max() < 0.01


def test_learning_brings_vectors_closer_to_the_corners():
    """The rotation that is learnt on vectors with few main directions fits its corners better than a random one."""
    draw = np.random.default_rng(4)
    vectors = embeddings.unit(draw.normal(size=(1_500, 24)) * np.linspace(3, 0.3, 24))
    directions, medians = embeddings.rotations(vectors, 24)
    centred = vectors - vectors.mean(axis=0)
    turned = centred @ np.linalg.qr(draw.normal(size=(24, 24)))[0]

    def loss(x):
        return ((np.where(x > np.median(x, axis=0), 1, -1) - x) ** 2).sum()

    assert loss(centred @ directions) < loss(turned)


@pytest.mark.parametrize("bits", [None, 12])
@pytest.mark.parametrize("common", [0.0, 1.0])
def test_join_near_the_threshold(spark, common, bits, monkeypatch):
    if bits:
        monkeypatch.setattr(embeddings, "LEAST_BITS", bits)
    draw = np.random.default_rng(6)
    vectors = _vectors(draw, 2_000, common)
    vectors = np.concatenate((vectors, _partners(draw, vectors[:800])))
    near = vectors @ vectors.T >= embeddings.THRESHOLD
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in embeddings.joined(rows).collect()}
    assert [got[k] for k in range(len(vectors))] == (near.sum(axis=1) - 1).tolist()
