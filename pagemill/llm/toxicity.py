"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, read_table, staged, utf8_list

#: Labelled rows that voters, label model and classifier are learned from: those with the least hash of doc_id.
MAX_LABELLED = 20_000
#: Stems of the lexicon, at most; letters of a stem; toxic rows that one must be in.
MAX_STEMS, STEM_LETTERS, MIN_SUPPORT = 400, (3, 6), 3
#: Share of toxic rows among those with a stem, smoothed, from which the stem votes.
MIN_PRECISION = 0.85
#: Stems with a voter of their own; the others share these many voters.
OWN_VOTERS, SHARED_VOTERS = 24, 8
#: Distinct words whose stems a Python worker keeps.
CACHE_WORDS = 100_000
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters: what insults often come with. Their accuracy is estimated like any other voter's.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[^\W\d_a-z]{3,}+\b[^\w\n]*+){5}"),
    "exclaims": re.compile(r"!{2,}"),
    "addresses": re.compile(r"\b(?:you|your|du|dein|tu|vous|eres|usted)\b", re.IGNORECASE),
    "stretched": re.compile(r"([^\W\d_])\1{3}"),
}


def remainder(doc_id: Column) -> Column:
    """CRC-32 of the id's text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _stems(text: Column) -> Column:
    """Distinct stems of a text: the first three to six letters of its words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))
    cut = [F.transform(F.filter(words, lambda w: F.char_length(w) >= n), lambda w: F.substring(w, 1, n)) for n in range(STEM_LETTERS[0], STEM_LETTERS[1] + 1)]  # noqa: B023
    return F.array_distinct(F.concat(*cut))


def learn_stems(rows: DataFrame) -> list[str]:
    """(text, toxic) → stems that toxic rows have and others don't, most frequent first, none a prefix of another.

    Among n stems, chance alone gives some a log-likelihood gain of ln n; a stem must have more. Of texts that
    share the least hash of their five-word shingles, near copies mostly, one counts.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 5))))
    rows = rows.withColumn("words", words).withColumn("least", least).groupBy("least").agg(F.min(F.struct(F.xxhash64("text"), "text", "toxic")).alias("r")).select("r.text", "r.toxic")
    each = rows.select("toxic", F.explode(_stems(F.coalesce("text", F.lit("")))).alias("stem"))
    counts = staged(each.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "stems")
    of_all = rows.agg(F.avg("toxic")).first()[0]
    n = counts.count()
    if not n or not 0 < of_all < 1:
        return []
    p = (F.col("t") + 0.5) / (F.col("t") + F.col("c") + 1)
    gain = F.col("t") * F.log(p / of_all) + F.col("c") * F.log((1 - p) / (1 - of_all))
    good = counts.where((F.col("t") >= MIN_SUPPORT) & (F.col("t") / (F.col("t") + F.col("c") + 0.5) >= MIN_PRECISION) & (gain >= math.log(n)))
    best = good.orderBy(F.col("t") - 10 * F.col("c"), F.char_length("stem"), "stem", ascending=[False, False, True]).limit(MAX_STEMS * 8).collect()
    stems: list[str] = []
    for r in best:
        if not any(r.stem.startswith(s) or s.startswith(r.stem) for s in stems):
            stems.append(r.stem)
    return stems[:MAX_STEMS]


class Voters:
    """Votes of a text: a bit for each stem of its own, each shared group of stems, each pattern, and for one, two and three stems found."""

    def __init__(self, stems: list[str]):
        self.of = {s: i if i < OWN_VOTERS else OWN_VOTERS + i % SHARED_VOTERS for i, s in enumerate(stems)}
        self.n_lexicon = OWN_VOTERS + SHARED_VOTERS
        self.n = self.n_lexicon + len(PATTERNS) + 3
        self.known: dict[str, tuple[str, ...]] = {}

    def _found(self, word: str) -> tuple[str, ...]:
        return tuple(word[:n] for n in range(STEM_LETTERS[0], STEM_LETTERS[1] + 1) if word[:n] in self.of and len(word) >= n)

    def __call__(self, text: str) -> np.ndarray:
        votes = np.zeros(self.n, np.float64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, found, hits = self.known, set(), 0
        for w in _WORD.findall(text.lower()):
            s = known.get(w)
            if s is None:
                s = known[w] = self._found(w)
            if s:
                found.update(s)
                hits += 1
        for s in found:
            votes[self.of[s]] = 1
        for j, p in enumerate(PATTERNS.values()):
            votes[self.n_lexicon + j] = p.search(text) is not None
        votes[-3:] = hits >= 1, len(found) >= 2, len(found) >= 3
        return votes


@dataclass
class LabelModel:
    """Class-conditional vote rates, and weights that discount correlated voters."""

    prior: float
    rates: np.ndarray  # (2, voters): share of votes among clean and among toxic texts
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        clean, toxic = np.clip(self.rates, 1e-6, 1 - 1e-6)
        gain = votes * np.log(toxic / clean) + (1 - votes) * np.log((1 - toxic) / (1 - clean))
        z = gain @ self.weights + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximisation over unlabelled votes.

    Each round estimates the voters' rates from the posterior; then the correlation of what is left of two
    voters' votes, given the posterior, shares one voter's weight among those that say the same.
    """
    q = start
    for _ in range(rounds):
        mass = np.stack([1 - q, q])
        rates = (mass @ votes + 0.05 * votes.mean(axis=0)) / (mass.sum(axis=1, keepdims=True) + 0.05)
        rest = votes - mass.T @ rates
        spread = rest.std(axis=0) + 1e-9
        related = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(related, 0)
        weights = 1 / (1 + np.where(related > 0.1, related, 0).sum(axis=1))
        model = LabelModel(prior, rates, weights)
        q = model.posterior(votes)
    return model


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the first weight is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty
        step = np.linalg.solve(h, x.T @ (q - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Stems and weights of the classifier, from at most MAX_LABELLED labels and one text of each.

    labels: doc_id, toxic. Of a repeated doc_id the text with the least hash counts. The rows must be those that may be learned from. Without toxic rows there are no
    stems, and the score is the same for all.
    """
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    least = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("r"))
    rows = staged(least.select("r.text", "toxic"), "learned")
    stems = learn_stems(rows)
    seen = _votes(rows.select(F.col("toxic").cast("long").alias("id"), "text"), stems).toPandas()
    if not len(seen):
        return stems, np.zeros(Voters(stems).n + 1)
    votes, toxic = np.stack(seen["votes"].to_numpy()), seen["id"].to_numpy()
    prior = float(np.clip(toxic.mean(), 0.01, 0.99))
    model = fit_label_model(votes, prior, np.where(votes[:, -3] > 0, 0.95, 0.01))
    return stems, fit_linear(votes, model.posterior(votes))


def _votes(rows: DataFrame, stems: list[str]) -> DataFrame:
    """(id, text) → id, votes array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                votes = np.stack([voters(t.decode()) for t in utf8_list(part.column("text"))])
                at = pa.array(np.arange(len(votes) + 1, dtype=np.int32) * voters.n)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(at, pa.array(votes.reshape(-1)))], ["id", "votes"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, votes array<double>")


def score(docs: DataFrame, stems: list[str], weights: np.ndarray) -> DataFrame:
    """doc_id, score of each whole text; null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                votes = np.stack([voters(t.decode()) for t in utf8_list(part.column("text"))])
                z = votes @ weights[1:] + weights[0]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document, learned from labels outside the held-out third.

    Null or empty text: scored as a text without votes. Null doc_id: not held out, not learned from. Rows with
    one doc_id each get a row. Empty labels: one score, the same for all. Empty documents: no rows.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    stems, weights = train(docs, labels.where(remainder(F.col("doc_id")) != 1))
    scored = score(docs, stems, weights)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
