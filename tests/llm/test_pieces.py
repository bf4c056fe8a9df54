"""Prefix counts and coding against the tokenizer library."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from faultline.llm import pieces
from faultline.llm.queries import QUERIES, piece_model

TEXTS = [
    None, "", " ", "   a", "a  b ", "\n", " \n x", "a\nb  \n\n   c", "<s>x</s>", "<0x0A>", "ＡＢ①", "▁x", "a▁b", "\x00",
    "    b" + " " * 37 + "abc", "x" * 500, "日本語 mixed été", "\t\ta", "👍🏽 a", "snake_case x² _ ²", "word " * 3000,
]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(piece_model())


def _random_texts(n):
    draw, signs = random.Random(5), " \n▁abc.,étheing日👍<>0x_²"
    return ["".join(draw.choice(signs) for _ in range(draw.randrange(40))) for _ in range(n)]


def test_counts_of_every_prefix(vocab):
    for text in [t for t in TEXTS if t and len(t) < 600] + _random_texts(200):
        steps = vocab.deltas(text)
        assert len(steps) == len(text)
        want = [len(vocab.library.encode(text[:k])) for k in range(len(text) + 1)]
        assert [pieces.tokens_at(steps, k) for k in range(len(text) + 1)] == want, text


def test_longest_prefix_within_a_budget(vocab):
    for text in _random_texts(60):
        steps = vocab.deltas(text)
        counts = [len(vocab.library.encode(text[:k])) for k in range(len(text) + 1)]
        for budget in (0, 1, 3, 10):
            assert pieces.longest_prefix(steps, budget) == max(k for k, c in enumerate(counts) if c <= budget)


def test_ids_are_the_library_s(vocab):
    texts = [t or "" for t in TEXTS] + _random_texts(300)
    for text, code in zip(texts, vocab.encode_all(texts)):
        assert np.frombuffer(code, "<u4").tolist() == vocab.library.encode(text), text


def test_decoding_any_ids(vocab):
    draw = random.Random(6)
    for _ in range(500):
        ids = [draw.choice((0, 1, 2, draw.randrange(3, 259), draw.randrange(259, 32000), 259)) for _ in range(draw.randrange(8))]
        assert vocab.decode(ids) == vocab.library.decode(ids), ids


def test_a_full_table_changes_nothing(vocab, monkeypatch):
    texts = _random_texts(100)
    want = [vocab.deltas(t) for t in texts]
    monkeypatch.setattr(pieces, "TABLE_CHARS", 20)
    fresh = pieces.Vocabulary(piece_model())
    assert [fresh.deltas(t) for t in texts] == want


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "kept") for i, t in enumerate(TEXTS)] + [(0, TEXTS[4], 8, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, lang string")


def test_counts_in_spark(docs, vocab):
    out = pieces.with_prefix_counts(docs, piece_model())
    assert set(out.columns) == {"doc_id", "text", "lang", "n_bytes", "n_tokens", "prefix_deltas"}
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(vocab.library.encode(text)))


def test_truncation_in_spark(docs, vocab):
    for r in pieces.truncated(pieces.with_prefix_counts(docs, piece_model()), 5).collect():
        assert len(vocab.library.encode(r["text"])) <= 5 and len(r["text"]) == r["n_kept"]


def test_ids_and_round_trip_in_spark(docs, vocab):
    model = piece_model()
    for r in pieces.with_ids(docs, model).withColumn("back", pieces.decoded(F.col("input_ids"), model)).collect():
        want = [1, *vocab.library.encode(r["text"] or ""), 2]
        assert list(r["input_ids"]) == want and r["n_tokens"] == len(want) and r["back"] == vocab.library.decode(want)


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert pieces.with_prefix_counts(none, piece_model()).count() == 0
    assert pieces.with_round_trip(none, piece_model()).count() == 0


def test_queries_on_whole_documents(spark, sf, vocab):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counted = QUERIES["op7_token_counts"](spark, sf).collect()
    coded = QUERIES["op9_sentencepiece"](spark, sf).collect()
    assert len(counted) == len(coded) == len(texts)
    for r in counted:
        n = len(vocab.library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    for r in coded:
        ids = [1, *vocab.library.encode(texts[r["doc_id"]]), 2]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(vocab.library.decode(ids).encode()).hexdigest()
        assert r["n_tokens"] == len(ids)


def test_the_model_file_is_a_parameter():
    assert pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")) == piece_model()
