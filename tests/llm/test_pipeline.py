"""The pipeline's stages take effect, one after the other."""

import re

import corpus_pipeline
import public_tokenizers
from sentencepiece import SentencePieceProcessor

from faultline.llm import decontaminate, toxicity
from faultline.llm.queries import QUERIES


def test_stages(spark, sf, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        apply(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 3 or docs.columns == columns
        counts.append({r["doc_id"] for r in docs.collect()})
    assert set(before) > counts[0] > counts[1] > counts[2] == counts[3]

    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scored = model.apply(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert counts[0] == {r["doc_id"] for r in scored if not r["predicted"]}

    def shingles(text):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    kept = sorted(counts[0])
    sets = {i: shingles(before[i]) for i in kept}
    least = {i: i for i in kept}
    changed = True
    pairs = [(a, b) for x, a in enumerate(kept) for b in kept[x + 1:] if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert counts[1] == {i for i in kept if least[i] == i}

    index = decontaminate.Index.of(
        [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 10)
    assert counts[2] == {i for i in counts[1] if not index.scan(before[i])[1]}

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in docs.collect():
        assert list(r["input_ids"]) == [1, *library.encode(before[r["doc_id"]] or ""), 2] and r["n_tokens"] == len(r["input_ids"])


def test_run_is_the_stages_in_order(spark, sf):
    rows = QUERIES["pipeline"](spark, sf)
    assert rows.count() > 0 and "input_ids" in rows.columns


def test_an_empty_table_passes_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, sf)
    assert docs.count() == 0
