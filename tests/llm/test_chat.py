"""Reply trees and the reversible template."""

import hashlib

import pytest
from pyspark.sql import functions as F

from faultline.llm import chat
from faultline.llm.queries import HARD_TEXT, QUERIES

HARD = [
    HARD_TEXT, "", None, "\\", "\\-", "\\t", "\\h", "####", "#\\##", "</turn></turn>\n", "</turn", "### user: hi</turn>\n",
    "\\\\h</turn>\\", "a: b", "line\nline", "été 👍", "x" * 50_000,
]


def test_escapes_are_reversible_and_hide_control_strings(spark):
    rows = spark.createDataFrame([(t or "",) for t in HARD], "t string")
    out = rows.select(
        "t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("back"),
        chat.escaped(F.col("t"), role=True).alias("r"),
        chat.unescaped(chat.escaped(F.col("t"), role=True), role=True).alias("role_back")).collect()
    for r in out:
        assert r["back"] == r["t"] == r["role_back"]
        assert "###" not in r["e"] and "</turn>" not in r["e"] and ":" not in r["r"]


def test_whatever_is_said_can_be_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "us: er\\", t) for k, t in enumerate(HARD)]
    rows += [(2, 0, None, "only"), (None, 3, "user", "no tree"), (None, None, "assistant", "first"), (3, 1, "b", "x"), (3, 1, "a", "x"), (3, 1, "a", "x")]
    table = spark.createDataFrame([(*r, 1, "own") for r in rows], "conv_id bigint, turn bigint, role string, text string, rank int, path string")
    out = chat.conversations(chat.linear(table, "conv_id", "turn"))
    out = {r["tree"]: r for r in out.withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert len(out) == 4
    for key, got in out.items():
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got["turns"]] == [(r[2] or "", r[3] or "") for r in want]
        assert got["loss"] == "".join(r[3] or "" for r in want if r[2] == "assistant")


def _tree(spark, rows):
    return spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")


def test_branches(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 3, "user", "more", 2.0), (1, 5, 4, "assistant", "late", None), (1, 6, 2, "user", "tie", -1.0),
        (1, 7, 2, "user", "tie", -1.0), (1, 8, 99, "user", "orphan", 0.0), (1, 9, 9, "user", "self", 9.0),
        (2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0), (2, 3, 1, "user", "below", 1.0),
        (3, 1, None, "user", "twice", 1.0), (3, 1, None, "user", "twice", 1.0), (3, None, 1, "user", "no node", 1.0),
        (None, 1, None, "user", "no tree", 1.0), (None, 2, 1, "assistant", "no tree", 1.0),
    ]
    tree = _tree(spark, rows)
    found = {(r["tree"], tuple(r["path"])): r["score"] for r in chat.paths(tree, F.col("score")).collect()}
    assert found == {
        (1, (1, 2, 6)): 4.0, (1, (1, 2, 7)): 4.0, (1, (1, 3, 4, 5)): 3.0, (1, (8,)): 0.0, (1, (9,)): 9.0,
        (3, (1,)): 1.0, (None, (1, 2)): 2.0}
    best = chat.best(chat.paths(tree, F.col("score")), 3).where("tree = 1").orderBy("rank").collect()
    assert [list(r["path"]) for r in best] == [[9], [1, 2, 6], [1, 2, 7]]


def test_a_long_thread_and_a_wide_one(spark):
    rows = [(1, k, k - 1 if k else None, "user", "t", 1.0) for k in range(300)]
    rows += [(2, k, 0 if k else None, "user", "t", float(k)) for k in range(500)]
    paths = chat.paths(_tree(spark, rows), F.col("score"))
    got = {r["tree"]: (r["n"], r["longest"]) for r in paths.groupBy("tree").agg(
        F.count("*").alias("n"), F.max(F.size("path")).alias("longest")).collect()}
    assert got == {1: (1, 300), 2: (499, 2)}


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.conversations(chat.linear(table, "conv_id", "turn")).count() == 0


def test_query(spark, sf):
    rows = QUERIES["op4_chat_formatting"](spark, sf).collect()
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    want[-7] = [(0, "user", HARD_TEXT), (1, "assistant", HARD_TEXT)]
    assert len(rows) == len(want)
    for r in rows:
        turns = sorted(want[r["conv_id"]])
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_a_repeated_node_is_said_once(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "yo", 0.0), (1, 2, 1, "assistant", "yo", 0.0), (1, 2, 1, "assistant", "zz", 0.0)]
    out = chat.conversations(_tree(spark, rows), F.col("score"))
    row = out.select(chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in row["turns"]] == [("user", "q"), ("assistant", "yo")] and row["loss"] == "yo"


def test_a_very_long_thread_and_a_tree_with_most_rows(spark):
    """Pointers and paths stay linear: 100,000 turns in a row, and a tree of 30,000 nodes of depth 15."""
    long = spark.range(100_000).selectExpr(
        "CAST(1 AS BIGINT) AS tree", "id + 1 AS node", "nullif(id, 0) AS parent", "if(id % 2 = 0, 'user', 'assistant') AS role",
        "CAST(id AS STRING) AS text", "1.0D AS score")
    wide = spark.range(30_000).selectExpr(
        "CAST(2 AS BIGINT) AS tree", "id + 1 AS node", "nullif((id + 1) DIV 2, 0) AS parent", "'user' AS role", "'t' AS text", "CAST(id AS DOUBLE) AS score")
    out = {r["tree"]: r for r in chat.conversations(long.unionByName(wide), F.col("score")).select(
        "tree", F.size(chat.turns_of(F.col("formatted"))).alias("turns"), F.size("loss_spans").alias("spans")).collect()}
    node, size = 30_000, 0
    while node:
        node, size = node // 2, size + 1
    assert (out[1]["turns"], out[1]["spans"]) == (100_000, 50_000) and out[2]["turns"] == size
