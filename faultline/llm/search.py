"""Ranked lexical search: summed short lists as one bounded iterator beside long lists.

1. The documents are read once into a forward index: the words of each, and of the terms that
   some query holds their ids and occurrences. Corpus counts come from it by aggregates.
2. The index is searched in shards of bounded size, in the tasks that read it; no posting is
   shuffled. In a shard, per query:

   - term at a time: the shortest lists are summed into accumulators, up to a share of the
     shard's documents. They are one iterator from then on, bounded by the largest sum.
   - document at a time: that iterator and the long lists, each bounded by its largest
     impact, are walked in document order, a block of documents at a time. Lists whose bounds
     together cannot lift a document above the k-th score so far give no candidates; they are
     only looked up for candidates of the others that can still get there.
3. A shard returns its best k per query. Scores are integers from corpus counts only, so the
   best k of all shards are exact, whatever the shards are.

Queries are the side with a bound: they are measured first, and beyond ``QUERY_CHARS``
characters dealt by query id into slices that are searched one after the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from faultline.session import scratch_path, scratch_scope
from faultline.sources.tables import stage, write_stage

#: Fixed values of the contract: what a term is once A-Z are lower-cased (on UTF-8 bytes it
#: finds the same terms as on characters), and the numbers of the score.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TF_SCALE, TF_WEIGHT, NORM_WEIGHT = 1_000_000_000, 1_000, 8

BEST = 10
#: Characters of the queries of a slice, postings of a shard, documents of a block.
QUERY_CHARS = 4_000_000
SHARD_POSTINGS = 1_000_000
BLOCK_DOCS = 2_048
#: Accumulators from short lists, as a share of the shard's documents.
SHORT_SHARE = 0.1

INDEX = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
    T.StructField("tfs", T.ArrayType(T.IntegerType()))])


def terms(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode().lower()) if text else []


@dataclass(frozen=True)
class Queries:
    """A slice of the queries: their ids, their distinct terms as numbers, and the numbering."""

    items: pa.Array
    terms: list[list[int]]
    numbers: dict[bytes, int]

    @classmethod
    def of(cls, items: pa.Table) -> "Queries":
        numbers: dict[bytes, int] = {}
        own: dict[object, dict[int, None]] = {}
        for item, text in zip(items.column(0).to_pylist(), items.column(1).to_pylist()):
            own.setdefault(item, {}).update(dict.fromkeys(numbers.setdefault(t, len(numbers)) for t in terms(text)))
        return cls(pa.array(list(own), items.schema.field(0).type), [list(x) for x in own.values()], numbers)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the weight of each query term."""

    documents: int
    words: int
    weights: np.ndarray

    @classmethod
    def of(cls, index: DataFrame, size: int) -> "Corpus":
        documents, words = index.where(F.col("n") > 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(size, np.int64)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[row["term"]] = row["count"]
        return cls(documents, words, np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64))


class Shard:
    """Posting lists of a bounded set of documents: positions in key order, and impacts."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray, corpus: Corpus):
        self.documents = len(n)
        docs = np.repeat(np.arange(len(n)), sizes)
        tf = tfs.astype(np.int64)
        norm = 100 - 90 + 90 * n * corpus.documents // max(1, corpus.words)
        impacts = corpus.weights[ids] * (TF_SCALE * tf // (TF_WEIGHT * tf + NORM_WEIGHT * norm[docs]))
        order = np.argsort(ids, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        self.starts = np.searchsorted(ids[order], np.arange(len(corpus.weights) + 1))

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.docs[part], self.impacts[part]

    def best(self, query: list[int], k: int, short_share: float = SHORT_SHARE) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best documents above 0; of equal ones the first positions."""
        lists = sorted((x for x in map(self.list, query) if len(x[0])), key=lambda x: len(x[0]))
        short, held = 0, 0
        while short < len(lists) and held + len(lists[short][0]) <= max(k, short_share * self.documents):
            held += len(lists[short][0])
            short += 1
        walked = lists[short:]
        if short:
            walked.append(_summed(lists[:short]))
        walked.sort(key=lambda x: int(x[1].max()))
        bounds = np.cumsum([int(x[1].max()) for x in walked])
        top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = 0
        for first in range(0, self.documents, BLOCK_DOCS):
            # Lists before this one reach no more than the least score together.
            leading = int(np.searchsorted(bounds, least, side="right"))
            if leading == len(walked):
                break
            parts = []
            for docs, impacts in walked[leading:]:
                a, b = np.searchsorted(docs, (first, first + BLOCK_DOCS))
                if a < b:
                    parts.append((docs[a:b], impacts[a:b]))
            if not parts:
                continue
            docs, scores = _summed(parts)
            for at in range(leading - 1, -1, -1):
                able = scores + bounds[at] > least
                docs, scores = docs[able], scores[able]
                if not len(docs):
                    break
                there, impacts = walked[at]
                place = np.minimum(np.searchsorted(there, docs), len(there) - 1)
                scores = scores + np.where(there[place] == docs, impacts[place], 0)
            better = scores > least
            if better.any():
                docs, scores = np.concatenate((top[0], docs[better])), np.concatenate((top[1], scores[better]))
                order = np.lexsort((docs, -scores))[:k]
                top = docs[order], scores[order]
                least = int(top[1][-1]) if len(order) == k else 0
        return top


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list from several: each position once, impacts added."""
    if len(lists) == 1:
        return lists[0]
    docs, impacts = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(docs, kind="stable")
    docs, impacts = docs[order], impacts[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[first], np.add.reduceat(impacts, first)


def indexed(docs: DataFrame, numbers: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Forward index (key, n, terms, tfs) of all documents over the numbered terms."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["key"], *INDEX])
    shared = spark.sparkContext.broadcast(numbers)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, ids, tfs = [], [], []
            for t in batch.column(1).to_pylist():
                found = terms(t)
                counts = Counter(map(number, found))
                counts.pop(None, None)
                n.append(len(found))
                ids.append(list(counts))
                tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                pa.array(tfs, pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(made, schema)


def _searched(index: DataFrame, queries: Queries, corpus: Corpus, k: int, item: T.StructField) -> DataFrame:
    """The best k rows (item, key, score) of each shard and query."""
    shared = index.sparkSession.sparkContext.broadcast((queries, corpus))
    schema = T.StructType([item, index.schema["key"], T.StructField("score", T.LongType())])

    def search(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus = shared.value
        rows = pa.Table.from_batches(waiting).combine_chunks()
        # Null keys come last.
        rows = rows.take(pc.sort_indices(rows.column("key"), null_placement="at_end")).combine_chunks()
        lists = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
        shard = Shard(
            rows.column("n").to_numpy(), lists[0].value_lengths().to_numpy(zero_copy_only=False),
            lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), corpus)
        who, where, scores = [], [], []
        for number, query in enumerate(queries.terms):
            docs, best = shard.best(query, k)
            who.append(np.full(len(docs), number))
            where.append(docs)
            scores.append(best)
        yield pa.RecordBatch.from_arrays([
            queries.items.take(pa.array(np.concatenate(who))),
            rows.column("key").combine_chunks().take(pa.array(np.concatenate(where))),
            pa.array(np.concatenate(scores), pa.int64())], names=schema.names)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch.column("terms").flatten()) + batch.num_rows
            if held >= SHARD_POSTINGS:
                yield from search(waiting)
                waiting, held = [], 0
        if held:
            yield from search(waiting)

    return index.where(F.size("terms") > 0).mapInArrow(shards, schema)


def _slices(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries (item, text) in slices of at most about ``QUERY_CHARS`` characters; a query is in one slice."""
    chars = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, math.ceil(chars / QUERY_CHARS))
    for part in range(count):
        table = queries.where(F.pmod(F.xxhash64("item"), F.lit(count)) == part).toArrow()
        if table.num_rows:
            yield table


def ranked(
    docs: DataFrame, queries: DataFrame, k: int = BEST, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The k best documents above score 0 of each query: item, rank (from 1), key, score.

    Equal scores are ordered by key, nulls last. Rows of equal query id are one query with
    the terms of all of them; rows of documents are documents of their own, repeated or not.
    Null and empty texts have no terms: such documents are not counted and such queries have
    no rows. The key and id columns keep their names and types.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    schema = T.StructType([asked.schema["item"], T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    path = scratch_path(spark, "ranked")
    with scratch_scope(spark):
        for table in _slices(asked):
            own = Queries.of(table)
            index = stage(indexed(docs, own.numbers, key, text), "search-index")
            out = out.unionByName(_searched(index, own, Corpus.of(index, len(own.numbers)), k, asked.schema["item"]))
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
        best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return write_stage(best.select(
            F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"), path)
