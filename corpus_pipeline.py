"""Corpus cleaning: toxic documents out, near copies out, benchmark documents out, texts to ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next one. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import decontaminate, ngram_join, pieces, toxicity
from faultline.session import remove_path, scratch_path, scratch_scope
from faultline.sources.tables import write_stage

PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the model from the labelled documents and drop what it predicts toxic."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.where(model.score(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return ngram_join.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text with begin and end, and their number."""
    model = pieces.read_model(public_tokenizers.path(PIECE_MODEL))
    return pieces.with_ids(docs, model).select("doc_id", "source", "lang", "n_tokens", "input_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A learnt model and a tokenizer are no SQL; ``tests/llm`` compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage leaves in the scratch folder goes when its result is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, apply in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            docs = write_stage(apply(spark, docs, sf_dir), path)
        if before is not None:
            remove_path(spark, before)
        before = path
    return docs
