"""Quality by Bradley-Terry pairwise ranking.

A document's score is a sum over features of its form (shares of byte classes and marks, words, lines, repetition,
compression), each cut into bins at quantiles of the training rows. That one document is preferred to another has
probability sigmoid(s_i - s_j); the scores are learnt from preference pairs, a document of label 1 before one of
label 0, by logistic loss on the difference of their features. Pairs are drawn anew in every step.

The threshold is a quantile of the training scores: the one with the fewest errors on rows that a model fitted
without them has scored. It becomes KEEP on a scale from 0 to 1, by the logistic function of the distance to it.

All labelled rows are learnt from, one text for an id. Features are made once for each text and written; cuts come from counts of all
rows' values, rounded to six binary digits; rows are dealt into groups of about GROUP, each task fits the weights to its
group, and they are averaged by rows, for the model and for those without a fold; the threshold comes from counts of all rows' scores,
in steps of 1 / STEP. The driver sees these counts and weights, no row. Scoring runs over every whole text, with no shuffle.

Defined cases: null text counts as empty, which has features like any other; null labels, and labels of held-out rows,
are never learnt from; a document that several label rows mark is good only if all say so; an id of several texts is
learnt by the text of least hash; without rows of both labels the score is the share of label 1 (one half without any);
repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import crc32_of_id, map_batches, saved, table

#: Sampled documents of each label; bins of a feature; pairs of a step and steps; the score at the threshold.
BINS, PAIRS, STEPS, KEEP = 16, 8192, 400, 0.7
#: Rows of a group, about; rows of the rarer label that it has at least, copies of others' if need be; steps of counted scores in one.
GROUP, RARE, STEP = 65_536, 64, 256
FOLDS, HELD = 4, 2
MARKS = b".,;:!?'\"()[]{}<>|/\\#*$%&@+-=_~^`"
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "control": [*range(10), *range(11, 32)], "wide": range(128, 256)}
OF_CLASS = np.zeros((256, len(CLASSES) + len(MARKS)))
for _i, _bytes in enumerate([*CLASSES.values(), *([m] for m in MARKS)]):
    OF_CLASS[list(_bytes), _i] = 1


def repeated_share(words: list[bytes], width: int = 3) -> float:
    """Share of the windows of ``width`` words that another window of the text equals."""
    n = len(words) - width + 1
    return 1 - len(set(zip(*(words[i : n + i] for i in range(width)), strict=True))) / n if n > 1 else 0.0


def features(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    """Numbers that describe the form of a whole text; every one is defined for the empty text."""
    raw = (text or "").encode()
    size = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ OF_CLASS / size
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    ends = sum(raw.count(x) for x in (b". ", b"! ", b"? ", b".\n", b"!\n", b"?\n")) + 1
    letters = [w for w in counts if w.isalpha()]
    return [
        *shares.tolist(), math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        len(counts) / n, math.log(len(counts) + 1) / math.log(n + 1), max(counts.values(), default=0) / n, float((lengths == 1).mean()), float((lengths > 15).mean()),
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n, sum(c for w, c in counts.items() if not w.isalpha() and w.isascii()) / n,
        sum(w.istitle() for w in letters) / max(1, len(letters)), len(words) / ends, len(raw) / m, 1 - len(set(lines)) / m, repeated_share(words), repeated_share(words, 1),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / m, sum(not x.lstrip()[:1].isalnum() for x in lines) / m, len(raw) / len(packer.compress(raw)) if raw else 1.0,
    ]


@dataclass
class Ranker:
    """Scores by bins: ``cuts`` (features x BINS - 1), ``weights`` (features x BINS), the threshold on their sums."""

    cuts: np.ndarray
    weights: np.ndarray
    threshold: float

    def sums(self, x: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(len(self.cuts)), binned(x, self.cuts)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.sums(x) - self.threshold + math.log(KEEP / (1 - KEEP))
        return np.where(self.sums(x) >= self.threshold, np.maximum(sigmoid(z), KEEP), sigmoid(z))  # rounding can't move the threshold


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (x[:, :, None] >= cuts[None]).sum(2)


def cuts_of(x: np.ndarray) -> np.ndarray:
    """Half of the cuts at quantiles, half evenly between two outer ones, so that rare large values have bins too."""
    half = (BINS - 1) // 2
    q = np.quantile(x, np.linspace(0, 1, half + 2)[1:-1], axis=0)
    low, high = np.quantile(x, [0.005, 0.995], axis=0)
    return np.sort(np.concatenate([q, np.linspace(low, high, BINS - 1 - half)]), axis=0).T + 1e-12


def fit_pairs(x: np.ndarray, good: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return fit_binned(binned(x, cuts), good)


def fit_binned(bins: np.ndarray, good: np.ndarray, seed: int = 7, rate: float = 0.05, decay: float = 2e-3) -> np.ndarray:
    """Weights by Adam on the logistic loss of PAIRS random pairs a step; bins (rows x features)."""
    rng = np.random.default_rng(seed)
    n, width = bins.shape
    at = bins.astype(np.int64) + BINS * np.arange(width)
    first, second = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(width * BINS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        i, j = rng.choice(first, PAIRS), rng.choice(second, PAIRS)
        if n > 2 * PAIRS:  # only rows of the pairs are looked at
            places = at[np.concatenate([i, j])]
            s = w[places].sum(1)
            pull = sigmoid(s[PAIRS:] - s[:PAIRS]) / PAIRS  # of the loss on x_i - x_j
            each = np.concatenate([-pull, pull])
        else:
            places = at
            s = w[at].sum(1)
            pull = sigmoid(s[j] - s[i]) / PAIRS
            each = np.bincount(j, pull, n) - np.bincount(i, pull, n)
        g = np.bincount(places.ravel(), np.repeat(each, width), len(w)) + decay * w / width
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w.reshape(width, BINS)


def best_quantile(s: np.ndarray, good: np.ndarray, weight: np.ndarray) -> float:
    """The share of (weighted) rows below the threshold that has the fewest errors; the middle one of equal ones."""
    order = np.argsort(s, kind="stable")
    y, w = good[order], weight[order]
    wrong = np.append(0, np.cumsum(np.where(y, w, -w))) + w[~y].sum()  # good rows below and bad rows above
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    below = np.append(0, np.cumsum(w))
    return float(below[least[len(least) // 2]] / below[-1])


def quantile(s: np.ndarray, weight: np.ndarray, q: float) -> float:
    """Half way between the last score below the quantile and the first above."""
    order = np.argsort(s, kind="stable")
    below = np.cumsum(weight[order]) / weight.sum()
    n = int(np.searchsorted(below, q - 1e-9, side="right")) if q > 0 else 0
    n += int(q > 0 and n < len(s) and abs(below[n] - q) <= 1e-9)
    held = s[order]
    return float((held[min(max(n, 1), len(s)) - 1] + held[min(n, len(s) - 1)]) / 2) if n else float(held[0])


def fit(x: np.ndarray, good: np.ndarray, shares: tuple[float, float], folds: int = 4) -> Ranker:
    """x (rows x features), good (label 1), how many rows of label 0 and 1 there are in all."""
    if not good.any() or good.all():
        prior = min(max(shares[1] / sum(shares), 1e-6), 1 - 1e-6) if sum(shares) else 0.5
        return Ranker(np.zeros((x.shape[1], BINS - 1)), np.zeros((x.shape[1], BINS)), math.log(KEEP / (1 - KEEP)) - math.log(prior / (1 - prior)))
    weight = np.where(good, shares[1] / good.sum(), shares[0] / (~good).sum())
    cuts = cuts_of(x)
    fold = np.zeros(len(x), int)
    for kind in (good, ~good):
        fold[kind] = np.arange(kind.sum()) % folds
    places = np.zeros(len(x))
    for k in range(folds):  # scores of rows by a model without them, as places among those of its own rows
        own = fold != k
        if not (good & own).any() or not (~good & own).any():
            continue
        w = fit_pairs(x[own], good[own], cuts)
        s = Ranker(cuts, w, 0.0).sums(x)
        held = np.sort(s[own])
        places[~own] = np.searchsorted(held, s[~own]) / len(held) + 1e-3 * sigmoid(s[~own])
    weights = fit_pairs(x, good, cuts)
    s = Ranker(cuts, weights, 0.0).sums(x)
    return Ranker(cuts, weights, quantile(s, weight, best_quantile(places, good, weight)))


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (text, ...): the columns ``keep`` and ``x``, the features of the whole text."""
    names = [*keep, "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            x = [features(t.as_py(), packer) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_batches(docs.select(*keep, "text"), run, f"{schema}, x array<double>")


def numbers_of(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def counted(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> dict[int, int]:
    """How often each key occurs in all rows. Tasks count first; there are to be few different keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                found, n = np.unique(keys(batch), return_counts=True)
                held, at = np.unique(np.concatenate([held, found]), return_inverse=True)
                times = np.bincount(at, np.concatenate([times, n]), len(held)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(times, pa.int64())], ["key", "n"])

    return {r.key: r.n for r in map_batches(rows, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def cuts_of_all(rows: DataFrame, width: int) -> np.ndarray:
    """The cuts of cuts_of() over all rows (x), from counts of values rounded to six binary digits; no feature is negative."""
    digits = 52 - 6
    every = np.arange(width, dtype=np.int64) << 20
    counts = counted(rows.select("x"), lambda b: (np.maximum(numbers_of(b.column(0), b.num_rows), 0).view(np.int64) >> digits) + every)
    held = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in held.tolist()], np.float64)
    half, cuts = (BINS - 1) // 2, []
    for f in range(width):
        own = held >> 20 == f
        values, below = ((held[own] & ((1 << 20) - 1)) << digits).view(np.float64), np.cumsum(n[own])
        at = lambda q, values=values, below=below: values[np.minimum(np.searchsorted(below, np.asarray(q) * below[-1]), len(values) - 1)]
        cuts.append(np.sort(np.concatenate([at(np.linspace(0, 1, half + 2)[1:-1]), np.linspace(*at([0.005, 0.995]), BINS - 1 - half)])))
    return np.array(cuts) + 1e-12


def fitted(rows: DataFrame, n: dict[bool, int], width: int, folds: int) -> dict[int, np.ndarray]:
    """Weights by the fold that is left out, -1 for none, from rows (doc_id, good, fold, bins): each group's, averaged by its rows."""
    groups = max(1, -(-sum(n.values()) // GROUP))
    few = min(n, key=lambda k: n[k])
    copies = min(groups, -(-RARE * groups // n[few]))  # of a row of the rarer label, so that every group has some
    first = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(groups))
    own = F.explode(F.sequence(F.lit(0), F.when(F.col("good") == few, F.lit(copies - 1)).otherwise(F.lit(0))))
    dealt = rows.withColumn("_i", own).withColumn("g", F.pmod(first + F.col("_i"), F.lit(groups)).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(-1, folds))))).where("k <> fold").select("g", "k", "doc_id", "good", "bins")

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")  # the same whatever the order that rows come in
        good = group.column("good").to_numpy()
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        w = fit_binned(bins, good) if good.any() and not good.all() else None
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "k": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(good) if w is not None else 0], pa.int64()), "w": pa.array([b"" if w is None else w.tobytes()], pa.binary())})

    units = dealt.repartition(min(4096, groups * (folds + 1)), "g", "k").groupBy("g", "k").applyInArrow(run, "g int, k int, n long, w binary")
    sums: dict[int, np.ndarray] = {}
    total: Counter[int] = Counter()
    for r in saved(units, "weights").where("n > 0").orderBy("k", "g").toLocalIterator():
        sums[r.k] = sums.get(r.k, 0) + np.frombuffer(r.w, np.float64) * r.n
        total[r.k] += r.n
    return {k: (w / total[k]).reshape(width, BINS) for k, w in sums.items()}


def best_share(places: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """best_quantile() of places that stand for rows of weights ``good`` and ``bad``."""
    own, at = np.unique(places, return_inverse=True)
    good, bad = np.bincount(at, good, len(own)), np.bincount(at, bad, len(own))
    wrong = np.append(0, np.cumsum(good - bad)) + bad.sum()
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9 * (1 + bad.sum()))
    below = np.append(0, np.cumsum(good + bad))
    return float(below[least[len(least) // 2]] / below[-1])


def threshold(rows: DataFrame, models: dict[int, np.ndarray], weight: dict[bool, float], width: int, folds: int) -> float:
    """Of rows (good, fold, bins): the quantile of the scores with the fewest errors on rows that a model without them has scored."""
    every = [models.get(k, models[-1]) for k in range(folds)] + [models[-1]]
    middle = 1 << 19

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        good, fold = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()
        bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
        out = []
        for k, w in enumerate(every):
            code = np.clip(np.floor(w[np.arange(width), bins].sum(1) * STEP).astype(np.int64) + middle, 0, 2 * middle - 1)
            out.append(((k * 2 + (fold == k)) * 2 + good << 20) + code)
        return np.concatenate(out)

    table_: dict[tuple[int, int, int], dict[int, int]] = {}
    for key, n in counted(rows.select("good", "fold", "bins"), keys).items():
        head, code = key >> 20, (key & ((1 << 20) - 1)) - middle
        table_.setdefault((head >> 2, head >> 1 & 1, head & 1), {})[code] = n
    places, good, bad = [], [], []
    total = {label: sum(table_.get((folds, 0, label), {}).values()) for label in (0, 1)}
    for k in range(folds):
        # A score's place among the rows that the model has learnt from, each label weighed as in all rows: folds need not have equal shares of labels.
        steps = []
        for label in (0, 1):
            own = table_.get((k, 0, label), {})
            held = np.array(sorted(own), np.int64)
            below = np.concatenate([[0], np.cumsum([own[c] for c in held.tolist()])]) / max(1, sum(own.values()))
            steps.append((held, below * total[label] / sum(total.values())))
        for label in (0, 1):
            for code, n in table_.get((k, 1, label), {}).items():
                place = sum(float(below[np.searchsorted(held, code)]) for held, below in steps)
                places.append(place + 1e-3 * float(sigmoid(np.float64(code / STEP))))
                good.append(n * weight[True] * label)
                bad.append(n * weight[False] * (1 - label))
    share = best_share(np.array(places), np.array(good), np.array(bad))
    last: Counter[int] = Counter()
    for label in (0, 1):
        last.update({c: n * weight[bool(label)] for c, n in table_.get((folds, 0, label), {}).items()})
    codes = np.array(sorted(last), np.int64)
    return quantile((codes + 0.5) / STEP, np.array([last[c] for c in codes.tolist()]), share)


def features_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, a hash of the text and its features, written once."""
    return saved(described(docs.select("doc_id", F.xxhash64("text").alias("_h"), "text"), "doc_id", "_h"), "features")


def train(docs: DataFrame, labels: DataFrame, most: int | None = None, folds: int = 4) -> Ranker:
    """docs (doc_id, text) or their features, labels (doc_id, quality): learns from all rows outside the held-out fold.
    With ``most`` the driver fits a sample of so many rows of each label, those of the smallest hashes."""
    fold = crc32_of_id(F.col("doc_id")) % FOLDS
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold != HELD)).groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("_good"))
    shares = {r["_good"]: r["n"] for r in marked.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    of_labels = (float(shares.get(0, 0)), float(shares.get(1, 0)))
    width = len(features("", zstandard.ZstdCompressor(level=1)))
    if most is not None:
        there = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
        marked = there.where("_good = 1").orderBy(*order).limit(most).unionByName(there.where("_good = 0").orderBy(*order).limit(most))
        docs = docs.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    known = docs if "x" in docs.columns else features_of(docs.where(fold != HELD))
    one = known.where(fold != HELD).join(marked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("_h", "x", "_good")).alias("_one"))
    one = one.select("doc_id", (F.col("_one._good") == 1).alias("good"), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(folds)).cast("int").alias("fold"), "_one.x")
    if most is not None:
        rows = one.orderBy("doc_id").collect()  # 2 * most rows
        return fit(np.array([r.x for r in rows], np.float64).reshape(len(rows), width), np.array([r.good for r in rows], bool), of_labels)
    one = saved(one, "labelled")
    n = {r.good: r["n"] for r in one.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit(np.zeros((0, width)), np.zeros(0, bool), of_labels)
    cuts = cuts_of_all(one, width)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = binned(numbers_of(batch.column(3), batch.num_rows), cuts).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "good", "fold", "bins"])

    ids = one.schema["doc_id"].dataType.simpleString()
    cut = saved(map_batches(one, bins, f"doc_id {ids}, good boolean, fold int, bins binary"), "bins")
    models = fitted(cut, n, width, folds)
    weight = {True: of_labels[1] / n[True], False: of_labels[0] / n[False]}
    return Ranker(cuts, models[-1], threshold(cut, models, weight, width, folds))


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """docs (doc_id, text) or their features: doc_id and score of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = numbers_of(batch.column(1), batch.num_rows) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else [], pa.float64())], ["doc_id", "score"])

    known = docs if "x" in docs.columns else described(docs.select("doc_id", "text"), "doc_id")
    return map_batches(known.select(F.col("doc_id").cast("long"), "x"), run, "doc_id long, score double")


def op12_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = features_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held = (crc32_of_id(F.col("doc_id")) % FOLDS == HELD).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
