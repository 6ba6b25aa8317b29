"""Toxicity by maximum-scoring segments (operator 6).

Training counts, in Spark, in how many distinct labelled texts of each class a
token occurs; tokens are words and their first letters.  A token's weight is
its log-odds between the classes under Dirichlet priors; tokens whose weight is
many standard deviations above zero form the lexicon, all other words weigh a
little below zero.  A text is then a sequence of weights, and one linear scan
finds all its maximal scoring segments, the passages.

Calibration: labelled texts are dealt into folds, and those of a fold are
scanned with a lexicon from the others.  The best segments of their clean texts
fix lambda and K by maximum likelihood: among n clean words the best segment
exceeds S with a chance of 1 - exp(-K * n * exp(-lambda * S)), an extreme-value
law.  (Words of real texts come in clumps, so lambda is fitted, not derived from
the shares of single words.)  The level lambda * S - ln(K * n) makes short and long
texts alike; a passage above level 0 is significant.  A logistic curve over the
best passage's level and the number of significant ones, fitted on the same
out-of-fold scans, gives the score.

The fit uses at most about ``MAX_LABELLED`` labelled rows, drawn by a hash of
their ids and written once; everything else reads all rows.

Edge cases: null, empty and wordless texts get the score of a text without
passages; rows of equal text, also repeated rows, have equal scores; labels that
are null are left out, and of several labels of one document the highest counts;
without labels of both classes every score is the share of toxic labels (0
without labels); an empty table gives no rows; only the named columns of
documents and doc_id and toxic of labels are read, others may carry any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import text_or_empty, written

#: Bound on labelled rows of a fit, met on average: rows are drawn by hash.
MAX_LABELLED = 30_000
#: Parts of the labelled texts; each is scanned with a lexicon from the others.
FOLDS = 8
#: Pseudo-count of a token in each class, and how many standard deviations a weight must lie above zero.
PRIOR, LEAST_Z, LEAST_WEIGHT = 0.5, 2.8, 1.5
#: Weight of words outside the lexicon, and lengths of prefixes that are tokens too.
DRIFT, PREFIXES = -0.25, (4, 5, 6)
THRESHOLD = 0.3
CACHED_WORDS = 400_000
#: Texts whose tokens are counted before they go to Spark.
COUNTED = 200
WORD = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    """A lower-case word and its prefixes, marked."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: lambda and ln K of the extreme-value law of clean texts.
    scale: float = 1.0
    log_k: float = 0.0
    #: Of the logistic curve over (1, log(1 + best), passages).
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.0
    #: Words whose weights a task remembers.
    kept_words: int = CACHED_WORDS

    def words(self) -> "_Words":
        return _Words(self.weights, self.kept_words)

    def level(self, score: float, n_words: int) -> float:
        return self.scale * score - self.log_k - math.log(max(1, n_words))

    def features(self, scores: list[float], n_words: int) -> tuple[float, float]:
        """Level of the best passage, and the log of the number of significant ones (0 for one or none)."""
        levels = [self.level(x, n_words) for x in scores]
        return max([x for x in levels if x > 0], default=0.0), math.log(max(1, sum(x > 0 for x in levels)))

    def score(self, known: "_Words", text: str) -> float:
        if not self.weights:
            return self.base
        scores, n_words = known.scan(text)
        best, passages = self.features(scores, n_words)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(best) + c * passages))))


class _Words(dict):
    """Weights of words as they stand in a text, 0 for those outside the lexicon."""

    def __init__(self, weights: dict[str, float], kept: int = CACHED_WORDS) -> None:
        self.weights, self.kept = weights, kept

    def __missing__(self, word: str) -> float:
        if len(self) > self.kept:
            self.clear()
        get = self.weights.get
        value = self[word] = max((get(t, 0.0) for part in WORD.findall(word) for t in tokens_of(part)), default=0.0)
        return value

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        at = np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))
        where = np.flatnonzero(at)
        return list(zip(where.tolist(), at[where].tolist(), strict=True))

    def scan(self, text: str) -> tuple[list[float], int]:
        """Scores of a text's passages, and its number of words."""
        words = text.lower().split()
        return [s for _, _, s in segments(self.hits(words))], len(words)


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in linear time.

    Every word that is no hit weighs ``drift``.  Candidates keep the running
    sum before and after them; a new one swallows the candidates back to the
    nearest that began lower, if that one also ended lower.
    """
    kept: list[list[float]] = []  # first, last, sum before, sum after, nearest candidate with a lower sum before
    total, last = 0.0, -1
    for position, weight in hits:
        total += drift * (position - last - 1)
        last = position
        new = [position, position, total, total + weight, -1]
        total += weight
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= new[2]:
                j = int(kept[j][4])
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
            j -= 1
    return [(int(a), int(b), after - before) for a, b, before, after, _ in kept]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, text_col: str = "text") -> DataFrame:
    """(text, toxic, fold) of distinct training texts, about ``max_rows`` labels at most; written once."""
    rows = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_rows / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about max_rows pairs of numbers, whatever the data: small enough to send to every executor.
    own = docs.select(F.col("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(drawn), "doc_id")
    once = own.groupBy(F.sha2("text", 256).alias("k")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return written(once.select("text", (F.col("toxic") > 0).alias("toxic"), F.pmod(F.xxhash64("k"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")


def token_counts(rows: DataFrame) -> DataFrame:
    """token, fold, clean, toxic: in how many texts of each class it occurs; token '' counts texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, COUNTED) for batch in batches for a in range(0, batch.num_rows, COUNTED)):
            both: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic, fold in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                own = both[1 if toxic else 0]
                own.update((t, fold) for t in {t for w in set(WORD.findall(text.lower())) for t in tokens_of(w)} | {""})
            keys = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([b[k] for k in keys], pa.int64()) for b in both)], names=["token", "fold", "clean", "toxic"])

    return rows.mapInArrow(count, "token string, fold int, clean long, toxic long").groupBy("token", "fold").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def lexicons(rows: DataFrame) -> tuple[list[dict[str, float]], int, int]:
    """A lexicon from the texts outside each fold and, last, one from all; numbers of clean and toxic texts."""
    counts = token_counts(rows)
    totals = {r.fold: (r.clean, r.toxic) for r in counts.where("token = ''").collect()}
    clean, toxic = (sum(t[k] for t in totals.values()) for k in (0, 1))
    if not clean or not toxic:
        return [], clean, toxic
    sums = {k: [F.sum(F.when(F.col("fold") == fold, F.col(k)).otherwise(0)) for fold in range(FOLDS)] for k in ("clean", "toxic")}
    by_fold = counts.where("token <> ''").groupBy("token").agg(*(x.alias(f"{k}{fold}") for k, own in sums.items() for fold, x in enumerate(own))).where("+".join(f"toxic{f}" for f in range(FOLDS)) + " > 0")

    def column(fold: int) -> Column:
        """Weight by the texts outside ``fold``; null where it is no word of that lexicon."""
        others = [f for f in range(FOLDS) if f != fold]
        of = {k: sum((F.col(f"{k}{f}") for f in others), F.lit(0)) + PRIOR for k in ("clean", "toxic")}
        n = {k: sum(totals.get(f, (0, 0))[at] for f in others) + 2 * PRIOR for at, k in enumerate(("clean", "toxic"))}
        weight = F.log(of["toxic"] / (n["toxic"] - of["toxic"] + 0.5)) - F.log(of["clean"] / (n["clean"] - of["clean"] + 0.5))
        z = weight / F.sqrt(1 / of["clean"] + 1 / of["toxic"])
        return F.when((z >= LEAST_Z) & (weight >= LEAST_WEIGHT), weight).alias(f"w{fold}")

    weights = by_fold.select("token", *(column(f) for f in range(FOLDS + 1))).where(" or ".join(f"w{f} is not null" for f in range(FOLDS + 1)))
    # Of the tokens of at most about MAX_LABELLED texts, those that speak clearly: bounded with the texts.
    found = weights.collect()
    return [{r.token: r[f"w{f}"] for r in found if r[f"w{f}"] is not None} for f in range(FOLDS + 1)], clean, toxic


def extreme_value_law(best: np.ndarray, n_words: np.ndarray, floor: float = LEAST_WEIGHT) -> tuple[float, float]:
    """lambda and ln K of P(best <= s) = exp(-K * n * exp(-lambda * s)) by maximum likelihood.

    Best segments below ``floor``, the least weight of a word of the lexicon, count as not above it.
    """
    seen = best >= floor
    s = np.where(seen, best, floor)

    def k_of(scale: float) -> float:
        return (seen.sum() + 0.5) / float((n_words * np.exp(-scale * (s - floor))).sum() + 1.0)  # times exp(scale * floor)

    def likelihood(scale: float) -> float:
        k = k_of(scale)
        return float((math.log(k * scale) + np.log(n_words[seen]) - scale * (s[seen] - floor)).sum() - k * (n_words * np.exp(-scale * (s - floor))).sum())

    low, high, golden = 0.02, 8.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if likelihood(a) > likelihood(b):
            high = b
        else:
            low = a
    return low, math.log(k_of(low)) + low * floor


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * (x.shape[1] - 1)) * max(1.0, len(y) / 1000)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def scans(rows: DataFrame, by_fold: list[dict[str, float]]) -> pd.DataFrame:
    """toxic, n_words and scores of passages of every drawn text, by its fold's lexicon."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Words(w) for w in by_fold]
        for batch in batches:
            out = []
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                words = text.lower().split()
                out.append((toxic, len(words), [s for _, _, s in segments(known[fold].hits(words))]))
            kinds = (pa.bool_(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], names=["toxic", "n_words", "scores"])

    return rows.mapInArrow(scan, "toxic boolean, n_words long, scores array<double>").toPandas()


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_LABELLED, text_col: str = "text") -> Model:
    """Learn from labelled rows outside the held-out quarter.

    What reaches the driver comes from the drawn texts alone, of which there are about ``max_rows`` at most.
    """
    rows = labelled(docs, labels, max_rows, text_col)
    found, clean, toxic = lexicons(rows)
    if not found or not found[-1]:
        return Model(base=toxic / max(1, clean + toxic))
    model = Model(found[-1])
    seen = scans(rows, found[:-1])
    tame = seen[~seen.toxic & (seen.n_words > 0)]
    if len(tame):
        model.scale, model.log_k = extreme_value_law(np.array([max(x, default=0.0) for x in tame.scores]), tame.n_words.to_numpy(float))
    x = np.array([[1.0, math.log1p(best), more] for best, more in (model.features(list(s), int(n)) for s, n in zip(seen.scores, seen.n_words, strict=True))])
    model.curve = _logistic(x, seen.toxic.to_numpy(float))
    return model


def score_of(model: Model, text: Column) -> Column:
    """Score of a text, 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model.words()
        for texts in batches:
            yield pd.Series([model.score(known, x) for x in texts], dtype="float64")

    return score(F.coalesce(text.cast("string"), F.lit("")))


def passages_of(model: Model, text: Column) -> Column:
    """Significant passages of a text: array of (first word, last word, score, chance of as good a one in as long a clean text)."""

    @F.pandas_udf("array<struct<first:int,last:int,score:double,chance:double>>")
    def passages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model.words()
        for texts in batches:
            out = []
            for x in texts:
                words = x.lower().split()
                found = ((a, b, s, model.level(s, len(words))) for a, b, s in segments(known.hits(words)))
                out.append([(a, b, s, -math.expm1(-math.exp(-level))) for a, b, s, level in found if level > 0])
            yield pd.Series(out)

    return passages(F.coalesce(text.cast("string"), F.lit("")))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns as they were."""
    return docs.where(score_of(model, F.col(text_col)) < threshold)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(F.col("doc_id"), held_out().alias("held_out"), score_of(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
