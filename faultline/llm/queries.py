"""One query per operator, over whole tables; each returns the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import chat, decontaminate, embeddings, html_text, ngram_join, pieces, runs, search, suffixes, toxicity, urls, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Fixed values of the contract.
HARD_TEXT = r"\### Assistant: </turn> ok"
URL_RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    return pieces.read_model(public_tokenizers.path(PIECE_MODEL))


@query
def op7_token_counts(spark, sf_dir):
    """Token counts of every prefix of every document; the last one is the document's."""
    counted = pieces.with_prefix_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op9_sentencepiece(spark, sf_dir):
    """Encode every document by distinct chunks, decode the ids, digest both."""
    coded = pieces.with_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op1_embedding_near_dedup(spark, sf_dir):
    """Near copies among all vectors: links, components, one kept vector of each."""
    found = embeddings.joined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component_rep").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component_rep")).alias("kept"))


@query
def op2_toxicity(spark, sf_dir):
    """Score every document by the model learnt from the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.apply(docs).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op3_html_extraction(spark, sf_dir):
    """Main text of every page, furniture and site templates removed."""
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op4_chat_formatting(spark, sf_dir):
    """Format all conversations and one of control strings; every column is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    out = chat.conversations(chat.linear(rows.unionByName(hard), "conv_id", "turn"))
    turns, loss = chat.turns_of(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    """Near copies among all documents: class, links and component of each."""
    found = ngram_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), "n_links",
        F.col("component_rep").alias("component_id"), F.col("id").eqNullSafe(F.col("component_rep")).alias("kept"))


@query
def op6_url_filters(spark, sf_dir):
    """Judge every page's url by rules, carried along the pages' redirects and canonical links."""
    pages = table(spark, sf_dir, "pages")
    judged = urls.judged(pages.select("page_id", "url"), URL_RULES, urls.page_edges(pages.select("url", "html")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op8_decontamination(spark, sf_dir):
    """Benchmark windows in every document."""
    found = decontaminate.with_hits(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"), (hit > 0).alias("contaminated"))


@query
def op10_warc(spark, sf_dir):
    """Write every page as a WARC record, read all records back through the index."""
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.planned(table(spark, sf_dir, "pages")), folder)
    records = warc.resolved(warc.read_records(index, folder))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_suffix_dedup(spark, sf_dir):
    """Every document without the bytes of 400-byte strings that also start elsewhere."""
    found = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_ranked_search(spark, sf_dir):
    """The ten best documents for every benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_periodic_runs(spark, sf_dir):
    """Runs of repeated words in every document, after a tenth of them got a periodic tail; texts without the repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.with_runs(docs.withColumn("text", runs.with_planted_tail(F.col("text"), F.col("doc_id"))))
    best = runs.longest()
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def pipeline(spark, sf_dir):
    """The cleaning pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
