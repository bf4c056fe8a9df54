"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Terms (words and word beginnings) that mark toxic texts are mined from a bounded sample
   of labelled rows and dealt to lexicon voters; a fixed lexicon and text patterns vote too.
   A term is taken for its support and precision alone, whatever the number of terms; each one
   explains ``MIN_SUPPORT`` more sampled texts at least, so the sample bounds them.
   A voter says "toxic" or abstains; one more says "clean" where no lexicon speaks.
2. The vote patterns of all rows outside the held-out fold are counted in Spark (at most
   2**MAX_VOTERS patterns). Their covariances give each voter's hit rates by the triplet
   method, and what two voters share beyond that is their correlation, which discounts them.
3. A logistic regression on the terms is fitted to the posterior labels of the sample.

Labels are read only where crc32 of the id as text is no multiple of ``FOLDS``. Neither
labels nor id, language or source enter a score: it is a function of the text.

Only the sample's term counts, the vote patterns and the model reach the driver. Texts are
never shuffled: the sampled labels are broadcast, and their number is bounded.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.session import remove_path, scratch_path
from faultline.sources.tables import write_stage

FOLDS = 5
#: Labelled rows that are looked at, about so many of each class (chosen by a hash of the id).
SAMPLE_TOXIC, SAMPLE_CLEAN = 10_000, 20_000
#: A term is a candidate from so many toxic texts on, where the lower bound of its precision is high enough.
MIN_SUPPORT, MIN_PRECISION = 4, 0.5
LEXICON_VOTERS = 6
PREFIXES = (4, 5, 6)
MAX_VOTERS = LEXICON_VOTERS + 4
DEFAULT_PRIOR = 0.1

#: A small general lexicon in four languages, for tables with few labels or none.
LEXICON = (
    "idiot", "moron", "scum", "trash", "loser", "stupid", "pathetic", "worthless", "disgusting", "clown",
    "bastard", "bitch", "asshole", "dumbass", "retard", "vermin", "filth", "imbecile",
    "arschloch", "dummkopf", "abschaum", "schlampe", "wichser", "trottel", "missgeburt",
    "connard", "salope", "abruti", "ordure", "enculé", "crétin",
    "gilipollas", "imbécil", "estúpido", "cabrón", "basura", "escoria",
)
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[^\W\d_]\*{2,}[^\W\d_]*")
_ADDRESSED = frozenset(("you", "du", "ihr", "tu", "vous", "tú"))
_ADDRESS = re.compile(rf"\b(?:{'|'.join(sorted(_ADDRESSED))})\b[^.!?\n]{{0,40}}!{{2,}}")

Terms = tuple[str, ...]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def terms_of(text: str | None) -> set[str]:
    """Distinct words of a text and their beginnings, as ``begi*``."""
    words = words_of(text)
    return words.union(*({f"{w[:n]}*" for w in words if len(w) >= n} for n in PREFIXES))


class Lexicon:
    """Looks up many terms in a text at once."""

    def __init__(self, terms: Terms):
        self.size = len(terms)
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.starts: dict[int, dict[str, int]] = {}
        for i, t in enumerate(terms):
            if t.endswith("*"):
                self.starts.setdefault(len(t) - 1, {})[t[:-1]] = i

    def found(self, text: str) -> set[int]:
        return self.among(words_of(text))

    def among(self, words: set[str]) -> set[int]:
        hits = {self.words[w] for w in words & self.words.keys()}
        for n, table in self.starts.items():
            hits.update(table[s] for s in {w[:n] for w in words} & table.keys())
        return hits


def patterns(text: str, words: set[str]) -> tuple[bool, bool]:
    """Masked words, and an address that ends in a shout; sought only where their signs occur."""
    masked = "**" in text and _MASKED.search(text) is not None
    return masked, "!!" in text and not words.isdisjoint(_ADDRESSED) and _ADDRESS.search(text.lower()) is not None


@dataclass(frozen=True)
class ToxicityModel:
    """Terms, their dealing to voters, the label model's figures and the classifier."""

    terms: Terms
    prior: float
    hit_rates: tuple[tuple[float, float], ...]  # P(vote | toxic), P(vote | clean) by voter
    discounts: tuple[float, ...]
    weights: tuple[float, ...]  # by term, then general lexicon, masked, address
    intercept: float

    def score(self, text: Column) -> Column:
        """Probability of label 1, from the text alone; null and empty texts get the score of no feature."""
        model = self

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            features = Features(model.terms)
            weights = np.array(model.weights)
            at = [model.intercept + weights[features.of(t)].sum() for t in texts.fillna("")]
            return pd.Series(1 / (1 + np.exp(-np.clip(at, -500, 500))), dtype="float64")

        return scored(text)

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add score and predicted; columns of these names are replaced, others and all rows kept."""
        kept = [c for c in docs.columns if c not in ("score", "predicted")]
        rows = docs.select(*kept, self.score(F.col(text)).alias("score"))
        return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


class Features:
    """The positions of a text's features among terms, general lexicon and patterns."""

    def __init__(self, terms: Terms):
        self.lexicon, self.general, self.size = Lexicon(terms), frozenset(LEXICON), len(terms) + 3

    def of(self, text: str) -> list[int]:
        base = self.lexicon.size
        words = words_of(text)
        masked, address = patterns(text, words)
        out = sorted(self.lexicon.among(words))
        out += [base] * (not words.isdisjoint(self.general)) + [base + 1] * masked + [base + 2] * address
        return out

    def votes(self, found: list[int]) -> int:
        """The votes as bits: lexicon voters, general lexicon, masked, address, clean."""
        base, bits = self.lexicon.size, 0
        for i in found:
            bits |= 1 << (i % LEXICON_VOTERS if i < base else LEXICON_VOTERS + i - base)
        spoken = bits & ((2 << LEXICON_VOTERS) - 1)
        return bits if spoken else bits | 1 << (MAX_VOTERS - 1)


def held_out(key: Column) -> Column:
    """Rows from which no label is learnt; a null id is none of them."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _sampled(labels: DataFrame, key: str, label: str) -> tuple[DataFrame, dict[int, float], float]:
    """Bounded labels of the training folds, the weight of a row by label, the share of toxic rows."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_toxic")).where(
        F.col("_key").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_key")))
    known = known.groupBy("_key").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    limits = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    share = {y: min(1.0, limits[y] / max(1, counts.get(y, 0))) for y in (0, 1)}
    place = F.pmod(F.xxhash64("_key"), F.lit(1 << 52))
    sample = known.where(place < F.when(F.col("_toxic") == 1, math.ceil(share[1] * 2.0 ** 52)).otherwise(math.ceil(share[0] * 2.0 ** 52)))
    total = sum(counts.values())
    return sample, {y: 1 / share[y] for y in (0, 1)}, counts.get(1, 0) / total if total else DEFAULT_PRIOR


def _term_counts(rows: DataFrame) -> DataFrame:
    """Of each term the toxic and all texts that hold it, merged per task before the shuffle."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"]):
                (toxic if y else clean).update(terms_of(text))
            if len(toxic) + len(clean) > 500_000:
                yield frame(toxic, clean)
                toxic, clean = Counter(), Counter()
        if toxic or clean:
            yield frame(toxic, clean)

    def frame(toxic: Counter, clean: Counter) -> pd.DataFrame:
        names = list(toxic.keys() | clean.keys())
        return pd.DataFrame({"term": names, "toxic": [toxic[t] for t in names], "clean": [clean[t] for t in names]})

    counts = rows.mapInPandas(counted, "term string, toxic bigint, clean bigint")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lower_bound(hits: Column, total: Column, z: float = 1.96) -> Column:
    """Wilson's lower bound of a share."""
    p = hits / total
    middle = p + F.lit(z * z / 2) / total
    spread = F.sqrt(p * (1 - p) / total + F.lit(z * z / 4) / (total * total)) * z
    return (middle - spread) / (1 + F.lit(z * z) / total)


def _chosen(rows: DataFrame, weight: dict[int, float]) -> Terms:
    """Terms that explain toxic texts: the one that explains most new ones, again and again."""
    clean = F.col("clean") * (weight[0] / weight[1])
    candidates = _term_counts(rows).where(F.col("toxic") >= MIN_SUPPORT).select(
        "term", "toxic", lower_bound(F.col("toxic"), F.col("toxic") + clean).alias("bound")).where(
        F.col("bound") >= MIN_PRECISION)
    best = candidates.orderBy((F.col("bound") * F.col("toxic")).desc(), "term").collect()
    if not best:
        return ()
    bound = [r["bound"] for r in best]
    names = tuple(r["term"] for r in best)

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        lexicon = Lexicon(names)
        return pd.Series([sorted(lexicon.found(t)) for t in texts.fillna("")], dtype="object")

    toxic = [r["f"] for r in rows.where(F.col("toxic") == 1).select(present("text").alias("f")).collect()]
    holders: list[list[int]] = [[] for _ in names]
    for i, found in enumerate(toxic):
        for k in found:
            holders[k].append(i)
    open_rows, chosen = np.ones(len(toxic), bool), []
    # What a term explains only shrinks, so a value that is still the largest when renewed is the best one.
    waiting = [(-len(own) * bound[k], k) for k, own in enumerate(holders)]
    heapq.heapify(waiting)
    while waiting:
        value, k = heapq.heappop(waiting)
        gain = int(open_rows[holders[k]].sum()) if holders[k] else 0
        if -gain * bound[k] > value:
            heapq.heappush(waiting, (-gain * bound[k], k))
            continue
        if gain < MIN_SUPPORT:
            break
        chosen.append(names[k])
        open_rows[holders[k]] = False
    return tuple(chosen)


def label_model(counts: dict[int, int], prior: float, seen: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray]:
    """Hit rates (voter x toxic, clean) and discounts from the counts of vote patterns.

    For independent voters given the label, Cov(i, j) = Var(label) d_i d_j, with d the
    difference of a voter's two hit rates, so three voters give d. The median over all pairs
    of other voters is taken, which a few correlated pairs do not move. What a pair's
    covariance holds beyond that is its correlation. ``seen`` has weighted vote counts of
    labelled rows by (pattern, label); it serves where there are not three voters that speak
    together.
    """
    patterns_ = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns_], float)
    votes = (patterns_[:, None] >> np.arange(MAX_VOTERS)) & 1
    total = max(1.0, n.sum())
    mean = n @ votes / total
    cov = (votes * n[:, None]).T @ votes / total - np.outer(mean, mean)
    rates = np.zeros((MAX_VOTERS, 2))
    spread = prior * (1 - prior)
    for i in range(MAX_VOTERS):
        hit = [sum(v for (p, y), v in seen.items() if y == label and p >> i & 1) for label in (1, 0)]
        size = [sum(v for (_, y), v in seen.items() if y == label) for label in (1, 0)]
        known = [(hit[k] + (0.5 if size[k] else 0)) / (size[k] + 1) for k in (0, 1)]
        others = [j for j in range(MAX_VOTERS - 1) if j != i and cov[i, j] > 1e-9]
        found = [
            cov[i, j] * cov[i, k] / cov[j, k]
            for a, j in enumerate(others) for k in others[a + 1:] if cov[j, k] > 1e-9]
        if found and i < MAX_VOTERS - 1:
            d = math.sqrt(float(np.median(found)) / spread)
            d = min(d, mean[i] / prior)  # no vote on clean rows at most
            rates[i] = mean[i] + (1 - prior) * d, mean[i] - prior * d
        elif any(size):
            rates[i] = known
        elif i == MAX_VOTERS - 1:
            rates[i] = 0.5, 0.99
        else:
            rates[i] = 0.5, 0.01
    rates = np.clip(rates, 1e-4, 1 - 1e-4)
    d = rates[:, 0] - rates[:, 1]
    within = cov - spread * np.outer(d, d)
    speaks = mean * (1 - mean) > 1e-9
    scale = np.sqrt(np.where(speaks, mean * (1 - mean), 1.0))
    shared = np.clip(within / np.outer(scale, scale), 0, 1) * np.outer(speaks, speaks)
    np.fill_diagonal(shared, 0)
    return rates, 1 / (1 + shared.sum(axis=1))


def posterior(pattern: int, prior: float, rates: np.ndarray, discounts: np.ndarray) -> float:
    """Probability of label 1 given the votes; voters that abstain say nothing."""
    at = math.log(prior / (1 - prior))
    for i in range(MAX_VOTERS):
        if pattern >> i & 1:
            at += discounts[i] * math.log(rates[i, 0] / rates[i, 1])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, at))))


def _regression(rows: list[tuple[list[int], float, float]], size: int, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels by Newton's method; rows are features, label, weight."""
    owner = np.repeat(np.arange(len(rows)), [len(found) + 1 for found, _, _ in rows])
    column = np.array([c for found, _, _ in rows for c in (*found, size)], np.int64)
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    beta, keep = np.zeros(size + 1), np.append(np.full(size, ridge), 1e-6)

    def across(v: np.ndarray) -> np.ndarray:
        return np.bincount(owner, v[column], len(rows))

    def down(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, r[owner], size + 1)

    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(across(beta), -30, 30)))
        slope, curve = down(w * (y - p)) - keep * beta, w * p * (1 - p)
        step = _solved(lambda v: down(curve * across(v)) + (keep + 1e-9) * v, down(curve) + keep + 1e-9, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta[:size], float(beta[size])


def _solved(times: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Conjugate gradients on a positive definite matrix that is known by its products, scaled by its diagonal."""
    out, rest = np.zeros(len(wanted)), wanted.copy()
    along = scaled = rest / diagonal
    left = rest @ scaled
    for _ in range(20 * len(wanted)):
        if np.abs(rest).max() < 1e-10:
            break
        ahead = times(along)
        size = left / (along @ ahead)
        out, rest = out + size * along, rest - size * ahead
        scaled = rest / diagonal
        before, left = left, rest @ scaled
        along = scaled + left / before * along
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn the model from the rows outside the held-out fold.

    Null ids and labels other than 0 and 1 are ignored; a document with several labels is
    toxic if one says so, and of several texts under a labelled id the first in order is learnt
    from. Without any labelled row the general lexicon decides.
    """
    spark = docs.sparkSession
    sample, weight, prior = _sampled(labels, key, label)
    prior = min(max(prior, 0.01), 0.5)
    path = scratch_path(spark, "toxicity-sample")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), "_key").groupBy("_key").agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"))
    rows = write_stage(rows.select("text", "toxic"), path)
    terms = _chosen(rows, weight)

    @F.pandas_udf("array<int>")
    def seen(texts: pd.Series) -> pd.Series:
        features = Features(terms)
        return pd.Series([features.of(t) for t in texts.fillna("")], dtype="object")

    @F.pandas_udf("int")
    def votes(texts: pd.Series) -> pd.Series:
        features = Features(terms)
        return pd.Series([features.votes(features.of(t)) for t in texts.fillna("")], dtype="int32")

    counted = docs.where(~held_out(F.col(key))).select(votes(F.col(text)).alias("votes")).groupBy("votes").count()
    counts = {r["votes"]: r["count"] for r in counted.collect()}
    features = Features(terms)
    sampled = [(r["f"], features.votes(r["f"]), r["toxic"]) for r in rows.select(seen("text").alias("f"), "toxic").collect()]
    remove_path(spark, path)
    by_label: Counter = Counter()
    for _, pattern, y in sampled:
        by_label[pattern, y] += weight[y]
    rates, discounts = label_model(counts, prior, by_label)
    size = len(terms) + 3
    if sampled:
        weights, intercept = _regression(
            [(f, posterior(v, prior, rates, discounts), weight[y]) for f, v, y in sampled], size)
    else:
        weights, intercept = np.array([3.0] * len(terms) + [4.0, 1.0, 1.0]), math.log(prior / (1 - prior))
    return ToxicityModel(
        terms, prior, tuple(map(tuple, rates.tolist())), tuple(discounts.tolist()), tuple(weights.tolist()), intercept)
