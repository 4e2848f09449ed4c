"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all training text, they included, is unlabelled, a mix of both
classes with the class prior pi, which is the share of toxic rows among all labelled training rows. A linear
classifier over words is trained in numpy on the corrected risk

    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

with logistic loss; where the second term is negative, its gradient is reversed, so the classifier can't
explain unlabelled text as "less than no" negatives (non-negative PU learning).

Spark counts labels over all rows and picks the training sample (the rows with the smallest hashes, at
most MOST_POSITIVE and MOST_UNLABELLED); the driver sees only that bounded sample's word lists. Scoring runs
over every whole text; the model is a table of at most MOST_WORDS words.

Defined cases: null text counts as empty, whose score is that of no words (the bias); null labels, and
labels of held-out rows, are never learnt from; a document that several label rows mark counts as toxic if
one of them does; an id of several texts is learnt by the text of least hash; without positives or without unlabelled text the score is the prior everywhere; repeated
rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import crc32_of_id, map_batches, table

MOST_POSITIVE, MOST_UNLABELLED, MOST_WORDS = 3000, 7000, 30_000
FOLDS, HELD = 5, 0
#: A word counts if chance would make it so frequent among positives with this probability at most.
UNLIKELY = 1e-5
WORD = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    """Words, and beginnings of 4 and 5 letters of longer words (marked by a hyphen), which inflected forms share."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*((w[:4] + "-", w[:5] + "-") for w in words if len(w) > 5))


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        weights = self.weights
        z = self.bias + math.fsum([weights[w] for w in terms(text) if w in weights])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def by_chance(n: int, mean: float) -> float:
    """Probability of n or more where ``mean`` are expected (Poisson; its normal limit for large means)."""
    if mean > 50:
        return 0.5 * math.erfc((n - mean) / math.sqrt(2 * mean))
    term, below = math.exp(-mean), 0.0
    for k in range(n):
        below += term
        term *= mean / (k + 1)
    return max(0.0, 1 - below)


class Terms(dict):
    """Numbers for terms, in order of appearance."""

    def __missing__(self, term: str) -> int:
        out = self[term] = len(self)
        return out

    def of(self, terms: list[str]) -> np.ndarray:
        return np.array([self[t] for t in terms], np.int32)


def vocabulary(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str], prior: float) -> list[int]:
    """Terms that positives have far more often than other text, beyond what chance explains. How often other text has them is
    what the unlabelled share leaves after the positives' part of it."""
    count = lambda docs: np.bincount(np.concatenate([*docs, np.zeros(0, np.int32)]), minlength=len(names))
    p, u = count(positive), count(unlabelled)
    share = (u + 0.5) / (len(unlabelled) + 1)
    other = np.maximum((share - prior * p / len(positive)) / (1 - prior), 0.5 / (len(unlabelled) + 1))
    often = np.flatnonzero((p >= 2) & (p > 1.25 * other * len(positive))).tolist()
    sure = [i for i in often if by_chance(int(p[i]), float(other[i]) * len(positive)) < UNLIKELY]
    return sorted(sure, key=lambda i: (-p[i] / other[i], names[i]))[:MOST_WORDS]


def rows_of(docs: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of all documents' terms in a row, and each one's document."""
    found = [x[x >= 0] for x in (at[d] for d in docs)]
    return np.concatenate(found), np.repeat(np.arange(len(docs)), [len(x) for x in found])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], terms: Terms, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-3) -> Classifier:
    """Full-batch Adam on the non-negative risk."""
    if not positive or not unlabelled:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Classifier(math.log(p / (1 - p)))
    prior = min(max(prior, 1e-3), 0.999)  # all labels may be of one kind
    names = list(terms)
    known = vocabulary(positive, unlabelled, names, prior)
    n = len(known)
    at = np.full(len(names), -1)
    at[known] = np.arange(n)
    (pi, pd), (ui, ud) = rows_of(positive, at), rows_of(unlabelled, at)
    x = np.zeros(n + 1)  # weights, then the bias
    x[n] = math.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    value = lambda i, d, k: np.bincount(d, x[i], k) + x[n]
    slope = lambda i, d, g: np.append(np.bincount(i, g[d], n)[:n], g.sum()) / len(g)
    for step in range(1, steps + 1):
        fp, fu = value(pi, pd, len(positive)), value(ui, ud, len(unlabelled))
        missed = slope(pi, pd, -sigmoid(-fp))  # gradient of E_p[l(f)]
        as_negative = slope(ui, ud, sigmoid(fu)) - prior * slope(pi, pd, sigmoid(fp))
        risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g = -as_negative if risk < 0 else prior * missed + as_negative
        g = g + decay * np.append(x[:n], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(float(x[n]), {names[k]: float(x[i]) for i, k in enumerate(known) if x[i]})


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """docs (doc_id, text), labels (doc_id, toxic): learns from rows outside the held-out fold."""
    fold = crc32_of_id(F.col("doc_id")) % FOLDS
    marked = labels.where(F.col("toxic").isNotNull() & (fold != HELD)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    n, toxic = marked.agg(F.count("*"), F.sum(F.when(F.col("_toxic") == 1, 1).otherwise(0))).first()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    training = docs.where((fold != HELD) & F.col("text").isNotNull())
    toxic_ids = marked.where("_toxic = 1").select("doc_id")
    numbers = Terms()

    def sample(ids: DataFrame, most: int) -> list[np.ndarray]:
        """Terms of the documents with the smallest hashes among ``ids``, one text for an id: ``most`` at most are broadcast and as many collected."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sorted(terms(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["words"])

        few = ids.distinct().orderBy(order, "doc_id").limit(most)
        one = training.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_one"))
        texts = one.orderBy(order, "doc_id").select("_one.text")
        return [numbers.of(r.words) for r in map_batches(texts, run, "words array<string>").toLocalIterator()]

    sure = sample(training.select("doc_id").join(toxic_ids, "doc_id", "left_semi"), MOST_POSITIVE)
    rest = sample(training.select("doc_id"), MOST_UNLABELLED)  # known positives included, as the prior is that of all text
    return fit(sure, rest, numbers, (toxic or 0) / n if n else 0.5)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs (doc_id, text): doc_id and score of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = (crc32_of_id(F.col("doc_id")) % FOLDS == HELD).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
