"""Near copies among embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Iterative quantisation, on a bounded sample: vectors are turned to their main axes, then a
   rotation is learnt in turns, corners as the signs of the rotated vectors and the rotation
   that brings the vectors closest to them. A bit is the side of the median, so codes are
   balanced. More bits than dimensions come from further rotations, each from a start of its
   own.
2. A code is cut into substrings of equal length, one per table, and vectors with an equal
   substring meet. How many bits a pair at the threshold differs in is measured under the
   learnt code, on partners made around the sample's vectors, aside from them in any direction
   and along the data's own differences. There are as many tables as the harder kind needs to
   meet at least once but for a share of ``MISS``, so recall does not fall with the number of
   vectors or with a common direction. The length of a substring is the one that costs least
   for so many vectors; it is ``LEAST_BITS`` at least, however few they are. Substrings with
   flipped bits are not probed: more tables of equal ones take fewer rows. Where no number of
   tables will do (two vectors of a dimension, or all on one line: any balanced bit parts
   near ones) all vectors of that dimension meet in one table, in blocks like any hot key.
3. Pairs that meet pass if the first ``CODE_BITS`` of their codes are within a Hamming radius,
   five deviations above the measured mean. Those are compared by the cosine of the original
   vectors in double precision.

Equal vectors are one class. Per class and table a row of eight numbers moves, two of which
are the first bits of the code; whole codes and vectors move for rows that passed only, in the
groups where they passed. Finding the classes moves every vector once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.llm import blocks
from faultline.llm.blocks import GROUP, sorted_runs, with_links
from faultline.llm.components import components
from faultline.session import scratch_path, scratch_scope
from faultline.sources.tables import stage, write_stage

THRESHOLD = 0.9
#: A pair at the threshold shares no table, or is outside the radius, with about this probability.
MISS, DEVIATIONS = 1e-5, 5
LEAST_BITS, MAX_BITS = 4, 48
#: Bits of the code that tell pairs of a bucket apart, in two numbers.
CODE_BITS = 128
#: Vectors per dimension that the rotation is learnt on and the partners are made around.
SAMPLE = 2_000
#: Bits that angles and partners are measured on.
MEASURED_BITS = 1_024
#: Bits beyond which a code is of no use.
CODE_LIMIT = 1 << 17
#: What moving a row costs, in comparisons of two codes.
ROW_COST = 100
PAIRS_AT_ONCE = 65_536
ROUNDS = 15


def rotations(sample: np.ndarray, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of ``bits`` balanced bits, learnt from unit vectors.

    Each rotation alternates: corners are the signs of the rotated vectors, the rotation is
    the one that brings the vectors closest to them. Rotations differ in where they start.
    """
    draw = np.random.default_rng(seed)
    centred = sample - sample.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, values > max(values[-1], 0) * 1e-9]
    if not axes.shape[1]:
        axes = np.eye(sample.shape[1])
    spread = centred @ axes
    found = [np.zeros((sample.shape[1], 0))]
    while sum(f.shape[1] for f in found) < bits:
        size = axes.shape[1]
        rotation = np.linalg.qr(draw.normal(size=(size, size)))[0]
        for _ in range(ROUNDS):
            turned = spread @ rotation
            corners = np.where(turned > np.median(turned, axis=0), 1.0, -1.0)
            left, _, right = np.linalg.svd(spread.T @ corners)
            rotation = left @ right
        found.append(axes @ rotation)
    directions = np.concatenate(found, axis=1)[:, :bits]
    return directions, np.median(sample @ directions, axis=0)


@dataclass(frozen=True)
class Codes:
    """The learnt code of one dimension: directions, medians, bits of a substring, Hamming radius of the first bits."""

    directions: np.ndarray
    medians: np.ndarray
    bits: int
    radius: float

    @property
    def tables(self) -> int:
        return len(self.medians) // self.bits if self.bits else 1

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions > self.medians

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first bits as two numbers, and the substring of each table as a number."""
        signs = self.signs(unit)
        first = np.zeros((len(unit), CODE_BITS), bool)
        first[:, :min(CODE_BITS, signs.shape[1])] = signs[:, :CODE_BITS]
        code = np.packbits(first, axis=1).view(np.int64)
        return code, signs.reshape(len(unit), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def partners(sample: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector two at the threshold: aside in any direction, and along the data's differences."""
    draw = np.random.default_rng(seed)
    out = []
    for aside in (draw.normal(size=sample.shape), sample[draw.permutation(len(sample))] - sample[draw.permutation(len(sample))]):
        aside = aside - (aside * sample).sum(axis=1, keepdims=True) * sample
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.divide(aside, size, out=np.zeros_like(aside), where=size > 1e-9)
        out.append(THRESHOLD * sample + math.sqrt(1 - THRESHOLD ** 2) * aside)
    return out[0], out[1]


def missed(shares: np.ndarray, bits: int, tables: int) -> float:
    """How often pairs that differ in these shares of bits share no substring of any table."""
    return float(np.mean((1 - (1 - shares) ** bits) ** tables))


def needed(kinds: list[np.ndarray], bits: int) -> int:
    """Tables after which pairs of every kind are missed with probability ``MISS`` at most."""
    low, high = 1, 1
    while max(missed(s, bits, high) for s in kinds) > MISS:
        low, high = high, 2 * high
        if high * bits > CODE_LIMIT:
            return high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if max(missed(s, bits, middle) for s in kinds) <= MISS else (middle + 1, high)
    return high


def learnt(sample: np.ndarray, count: int) -> Codes:
    """The code for ``count`` vectors, learnt on the unit vectors in ``sample``."""
    directions, medians = rotations(sample, MEASURED_BITS)
    signs = sample @ directions > medians
    # Few vectors get several partners each.
    around = np.arange(max(len(sample), SAMPLE)) % len(sample)
    differ = [(p @ directions > medians) != signs[around] for p in partners(sample[around])]
    kinds = [d.mean(axis=1) for d in differ]
    packed = np.packbits(signs, axis=1)
    i, j = np.triu_indices(len(sample), 1)
    if len(i) > 200_000:
        some = np.random.default_rng(3).integers(0, len(i), 200_000)
        i, j = i[some], j[some]
    apart = np.bitwise_count(packed[i] ^ packed[j]).sum(axis=1) / MEASURED_BITS

    def cost(bits: int) -> float:
        bucket = count * float(np.mean((1 - apart) ** bits))
        return needed(kinds, bits) * (ROW_COST * max(1.0, bucket / blocks.BLOCK_ROWS) + bucket / 2)

    bits = min(range(LEAST_BITS, MAX_BITS + 1), key=cost)
    total = bits * needed(kinds, bits)
    if total > CODE_LIMIT:
        return Codes(directions[:, :0], medians[:0], 0, 0.0)
    if total > MEASURED_BITS:
        directions, medians = rotations(sample, total)
    first = [d[:, :min(CODE_BITS, total)].sum(axis=1) for d in differ]
    radius = max(float(f.mean() + DEVIATIONS * f.std()) for f in first)
    return Codes(directions[:, :total], medians[:total], bits, radius)


def usable(vector) -> bool:
    """Whether a vector links at all: not null or empty, no null or non-finite component, not zero."""
    if vector is None or not len(vector):
        return False
    values = np.asarray(vector, dtype=np.float64)
    return bool(np.isfinite(values).all() and values.any())


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square leaves the range of doubles."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _contents(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Per row: id, content (digest of the components, null for vectors that link with nothing), payload, size."""
    @F.pandas_udf("payload binary, content string")
    def content(column: pd.Series) -> pd.DataFrame:
        raw = [np.asarray(v, "<f8").tobytes() if usable(v) else None for v in column]
        return pd.DataFrame({
            "payload": raw,
            "content": [None if r is None else hashlib.blake2b(r, digest_size=16).hexdigest() for r in raw]})

    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), content(F.col(vector).cast("array<double>")).alias("made"))
    return stage(rows.select(
        "id", "made.payload", "made.content", (F.length("made.payload") / 8).cast("int").alias("size")), "vectors")


def planned(classes: DataFrame) -> dict[int, Codes]:
    """The code of each dimension that two classes share, learnt on a bounded sample of each in one job."""
    sizes = classes.groupBy("size").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    counts = {r["size"]: r["count"] for r in sizes.collect()}
    if not counts:
        return {}
    drawn = F.pmod(F.xxhash64("content"), F.lit(1_000_000_000)) < F.ceil(F.lit(SAMPLE * 1e9) / F.col("count"))
    rows = classes.join(sizes, "size").where(drawn).select("size", "payload", "content").collect()
    samples: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["content"]):
        samples.setdefault(r["size"], []).append(np.frombuffer(r["payload"], "<f8"))
    return {size: learnt(unit(np.array(found)), counts[size]) for size, found in samples.items()}


def joined(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: id, content, rep, n_links, component_rep.

    Links are pairs of rows with a cosine of 0.9 or more; vectors of different length, and
    those that are null, zero or hold null or non-finite components, link with nothing.
    ``n_links`` counts the other rows linked directly, ``component_rep`` is the smallest id
    that links reach. Repeated rows are rows of their own and link with each other.
    """
    path = scratch_path(vectors.sparkSession, "vectors-joined")
    with scratch_scope(vectors.sparkSession):
        return write_stage(_joined(vectors, key, vector), path)


def _joined(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = _contents(vectors, key, vector)
    classes = rows.where(F.col("content").isNotNull()).groupBy("content").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("payload").alias("payload"),
        F.first("size").alias("size"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    codes = planned(classes)
    rows = rows.drop("payload", "size")
    nothing = classes.where(F.lit(False)).select("cid", F.lit(0).cast("bigint").alias("links"), F.col("cid").alias("component"))
    linked = _linked(classes, codes) if codes else nothing
    return with_links(rows, classes.drop("payload", "size"), linked, F.col("id"))


def _linked(classes: DataFrame, codes: dict[int, Codes]) -> DataFrame:
    """Per class with links: cid, links (copies of other classes), component (smallest cid)."""
    shared = classes.sparkSession.sparkContext.broadcast(codes)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                known = shared.value.get(size)
                for start in range(0, len(part) if known else 0, 1_024):
                    some = part.iloc[start:start + 1_024]
                    code, numbers = known.of(unit(np.frombuffer(b"".join(some["payload"]), "<f8").reshape(len(some), -1)))
                    yield pd.DataFrame({
                        "cid": some["cid"].to_numpy(), "size": size, "left": code[:, 0], "right": code[:, 1], "numbers": list(numbers)})

    known = classes.where(F.col("size").isin(*codes)).select("cid", "size", "payload").mapInPandas(
        coded, "cid bigint, size int, left bigint, right bigint, numbers array<bigint>")
    known = stage(known, "vector-codes")
    keys = known.select("cid", "left", "right", "size", F.posexplode("numbers").alias("place", "number")).select(
        "cid", "left", "right", "place", F.xxhash64("size", "place", "number").alias("key"))
    radii = {size: c.radius for size, c in codes.items()}
    # Vectors of one length meet under keys of their own, so the widest radius loses none.
    survivors = stage(_passed(_grouped(keys), max(radii.values())), "vector-passed")
    dressed = survivors.join(classes.select("cid", "copies", "payload"), "cid").join(
        known.select("cid", "numbers"), "cid")
    links = stage(_verified(dressed, shared), "vector-links")
    groups = components(links, "cid", "root", "cid", "component")
    totals = links.groupBy("cid").agg(F.sum("links").alias("links"))
    return stage(totals.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "vector-linked")


def _grouped(keys: DataFrame) -> DataFrame:
    """Of (cid, left, right, place, key) the rows by group: a key, or a pair of blocks of a key with many rows."""
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > blocks.BLOCK_ROWS)
    many = stage(counts.select("key", F.ceil(F.col("size") / blocks.BLOCK_ROWS).cast("int").alias("blocks")), "vector-keys")
    rows = keys.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "cid", "left", "right", "place", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *GROUP).sortWithinPartitions(*GROUP)


def _near(run: pd.DataFrame, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group (positions in it) within the radius, some at a time; of two blocks one of each."""
    lo, hi = run["lo"].iat[0], run["hi"].iat[0]
    mine = run["mine"].to_numpy()
    first = np.flatnonzero(mine == lo)
    second = np.flatnonzero(mine == hi)
    left, right = (run[c].to_numpy().view(np.uint64) for c in ("left", "right"))
    step = max(1, PAIRS_AT_ONCE // max(1, len(second)))
    for start in range(0, len(first), step):
        a = first[start:start + step, None]
        b = second[None, :]
        differ = np.bitwise_count(left[a] ^ left[b]) + np.bitwise_count(right[a] ^ right[b])
        stay = differ <= radius
        if lo == hi:
            stay &= a < b
        i, j = np.nonzero(stay)
        if len(i):
            yield first[start + i], second[j]


def _passed(rows: DataFrame, radius: float) -> DataFrame:
    """The rows that are within the radius of some row of their group."""
    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, waiting = [], 0
        for run in sorted_runs(batches, GROUP):
            if len(run) < 2:
                continue
            met = np.zeros(len(run), bool)
            for i, j in _near(run, radius):
                met[i] = met[j] = True
            if met.any():
                out.append(run[met])
                waiting += len(out[-1])
            if waiting > 5_000:
                yield pd.concat(out)
                out, waiting = [], 0
        if out:
            yield pd.concat(out)

    return _dealt(rows).mapInPandas(passed, "cid bigint, left bigint, right bigint, place int, key bigint, lo int, hi int, mine int")


def _verified(rows: DataFrame, shared) -> DataFrame:
    """Per group and class its links and a root of its connected part there: cid, links, root.

    A pair that meets in several tables counts in the first one, which its codes tell.
    """
    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        radius = max(c.radius for c in shared.value.values())
        for run in sorted_runs(batches, GROUP):
            if len(np.unique(run["cid"].to_numpy())) < len(run):
                run = run.drop_duplicates("cid")
            sizes = run["payload"].map(len)
            # Keys of two lengths may collide.
            for part in [run] if sizes.min() == sizes.max() else [p for _, p in run.groupby(sizes)]:
                if len(part) < 2:
                    continue
                units = unit(np.frombuffer(b"".join(part["payload"]), "<f8").reshape(len(part), -1))
                numbers = np.stack(part["numbers"].to_numpy())
                cid, copies, table = part["cid"].to_numpy(), part["copies"].to_numpy(), int(part["place"].iat[0])
                links, pairs = np.zeros(len(part), np.int64), []
                for i, j in _near(part, radius):
                    good = np.einsum("ij,ij->i", units[i], units[j]) >= THRESHOLD
                    i, j = i[good], j[good]
                    good = _first_here(numbers, i, j, table)
                    i, j = i[good], j[good]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    pairs.append((i, j))
                met = links > 0
                if met.any():
                    roots = blocks._roots(len(part), np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs]))
                    yield pd.DataFrame({"cid": cid[met], "links": links[met], "root": cid[roots][met]})

    return _dealt(rows).mapInPandas(verified, "cid bigint, links bigint, root bigint")


def _first_here(numbers: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Which pairs share no earlier table than this one."""
    out = np.ones(len(i), bool)
    for start in range(0, len(i) if table else 0, 4_096):
        part = slice(start, start + 4_096)
        out[part] = ~(numbers[i[part], :table] == numbers[j[part], :table]).any(axis=1)
    return out
