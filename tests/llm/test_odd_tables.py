"""Every query over tables that are empty, and over tables with odd rows."""

import hashlib

import pytest

from faultline.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r["conv_id"] for r in rows] == [-7] if name == "op4_chat_formatting" else rows == []


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Nulls in every column, repeated rows, a very long text, and columns whose names the operators use."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet").limit(20)
        nothing = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
        rows = df.unionByName(df.limit(3)).unionByName(nothing).unionByName(nothing)
        if name in ("documents", "benchmark"):
            key = df.columns[0]
            rows = rows.unionByName(df.limit(1).selectExpr(
                *(f"repeat('lang und länger. ', 40000) AS text" if c == "text" else f"{c} + 100000 AS {c}" if c == key else c for c in df.columns)))
        extra = rows.selectExpr(
            "*", "'x' AS content", "1 AS n_tokens", "0.5D AS score", "'y' AS host", "2 AS rank", "3 AS cid", "4 AS links",
            "'z' AS digest", "array(1) AS hits", "5 AS component", "6 AS node", "7 AS tree", "8 AS _row")
        extra.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    count = {t: spark.read.parquet(f"{odd}/{t}.parquet").count() for t in TABLES}
    table = {"op1": "embeddings", "op3": "pages", "op6": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    if name == "op4_chat_formatting":
        assert len(rows) == 2 + spark.read.parquet(f"{odd}/conversations.parquet").where("conv_id IS NOT NULL").select("conv_id").distinct().count()
    elif name == "op12_ranked_search":
        ranks = {}
        for r in rows:
            ranks.setdefault(r["item_id"], []).append(r["rank"])
        assert ranks and all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 10 for x in ranks.values())
    elif name == "pipeline":
        assert 0 < len(rows) < count["documents"]
    else:
        assert len(rows) == count[table]
    if name == "op10_warc":
        assert sum(r["payload_digest"] == hashlib.sha256(b"").hexdigest() for r in rows) == 2
