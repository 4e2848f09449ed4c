"""Scoring by a gated recurrent language model with a class-factored output.

Counts of words over all training documents (all texts but a held-out fold) are the base. The model's
vocabulary is the head of that table, MOST_WORDS words at most, dealt into classes of equal size by
frequency; a word has probability P(class | state) * P(word | class, state), two small softmaxes instead of
one large. The document end is a word of the vocabulary; every other word is the unknown word, which
is spelt out by the base: its share of the base's mass outside the vocabulary. So all tokens get a proper
probability, and base and model score the same tokens.

Training is truncated backpropagation through time in numpy: texts side by side in streams, windows of WINDOW
tokens, the state carried from window to window and reset at each document's end. The network learns from all
training documents, each once: in every round (ROUNDS are shares of the documents, by a hash of their ids) each
task trains a copy on its texts and the copies are averaged by tokens. A copy sees COPY_TOKENS tokens or more (small
partitions are put together, unmoved), so what is learnt does not hang on how finely a table is cut. Scoring carries the state across windows
through a whole document, many documents side by side, so a text of any length needs the memory of one window.

The counts of the head are broadcast (HEAD words at most); words beyond it are counted per document,
joined with their counts by a shuffle, and summed per document, so nothing that grows with the corpus
is broadcast or collected.

Defined cases: null text counts as empty: the end alone; a null doc_id counts as the empty id text for
the folds; rows that repeat a text get equal scores, up to rounding; a corpus without training text has the end
alone in its vocabulary; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import crc32_of_id, gathered, map_batches, saved, table
from semindex.llm.spellings import of_each, words_of_texts

FOLDS, HELD = 7, 2
#: Words of the model, of the broadcast head of the counts; classes; size of the state; windows and streams.
MOST_WORDS, HEAD, CLASSES, STATE, WINDOW, WINDOWS, STREAMS = 4096, 100_000, 64, 16, 16, 64, 512
#: Shares of the training documents that the rounds take, one after the other; first rate; networks that are added up at once;
#: tokens that a copy sees in a round at least, about.
ROUNDS, RATE, FAN, COPY_TOKENS = (1, 5), 0.01, 8, 2_000_000
END = b""  # no word is empty


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words, then the end."""
    return [*text.encode().lower().split(), END] if text else [END]


@dataclass
class Gru:
    """The network. Word numbers: 0 is the end, 1 any unknown word, then by frequency; classes are blocks of numbers."""

    words: int
    p: dict[str, np.ndarray]

    @staticmethod
    def start(counts: np.ndarray, seed: int = 7) -> Gru:
        """Small random weights; output biases start at the words' log frequencies."""
        n, rng = len(counts), np.random.default_rng(seed)
        size = -(-n // CLASSES)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        filled = np.zeros(size * CLASSES)
        filled[:n] = counts + 0.5
        by_class = filled.reshape(CLASSES, size)
        mass = np.maximum(by_class.sum(1), 1e-9)
        with np.errstate(divide="ignore"):
            within = np.maximum(np.log(by_class / mass[:, None]), -30)
        p = {
            "x": small(n, 3 * STATE), "u": small(STATE, 3 * STATE), "b": np.zeros(3 * STATE, np.float32),
            "c": small(STATE, CLASSES) * 0, "cb": np.log(mass / mass.sum()).astype(np.float32),
            "w": small(CLASSES, STATE, size) * 0, "wb": within.astype(np.float32),
        }
        return Gru(n, p)

    @property
    def size(self) -> int:
        return self.p["wb"].shape[1]

    def step(self, h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """State after a word: update gate z, reset gate r, candidate c."""
        x = np.take(self.p["x"], word, axis=0)
        x += self.p["b"]
        g = h @ self.p["u"]
        zr = x[:, : 2 * STATE] + g[:, : 2 * STATE]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :STATE], zr[:, STATE:]
        c = np.tanh(x[:, 2 * STATE :] + r * g[:, 2 * STATE :])
        return h + z * (c - h), z, r, c, g[:, 2 * STATE :]

    def sorted_by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """An order by class, the classes and places in that order, and where each class begins."""
        kind = (target // self.size).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        kind, place = kind[order], (target % self.size)[order]
        return order, kind, place, np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target word given its state: by class, so that a class is one product."""
        order, kind, place, cuts = self.sorted_by_class(target)
        h = h[order]
        every = np.arange(len(h))

        one = np.ones(max(CLASSES, self.size), h.dtype)

        def logs(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            own = logits[every[: len(at)], at]
            return own - np.log(np.exp(logits, out=logits) @ one[: logits.shape[1]])

        found = logs(h @ self.p["c"] + self.p["cb"], kind)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                inner = h[a:b] @ self.p["w"][k]
                inner += self.p["wb"][k]
                found[a:b] += logs(inner, place[a:b])
        out = np.empty(len(h))
        out[order] = found
        return out

    def train_window(self, h: np.ndarray, before: np.ndarray, target: np.ndarray, reset: np.ndarray, adam: Adam) -> tuple[np.ndarray, float]:
        """One window (time x streams): forward, backpropagation within the window, update; returns the carried state and the loss."""
        p, steps, grads = self.p, [], {k: np.zeros_like(v) for k, v in self.p.items()}
        n, streams = target.size, before.shape[1]
        hs = np.empty((len(before), streams, STATE), h.dtype)
        for t in range(len(before)):
            h = h * ~reset[t][:, None]
            new = self.step(h, before[t])
            steps.append((h, *new))
            h = hs[t] = new[0]
        order, kind, place, cuts = self.sorted_by_class(target.ravel())
        flat = hs.reshape(n, STATE)[order]
        every, share, loss, one = np.arange(n), flat.dtype.type(1 / n), 0.0, np.ones(max(CLASSES, self.size), h.dtype)

        def wrong(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            """What the softmax is off its target, a share of the window's mean loss; in place."""
            nonlocal loss
            q = np.exp(logits, out=logits)
            q *= (share / (q @ one[: q.shape[1]]))[:, None]
            own = every[: len(at)], at
            loss -= float(np.log(q[own] * n + 1e-30).sum())
            q[own] -= share
            return q

        q = wrong(flat @ p["c"] + p["cb"], kind)
        grads["c"], grads["cb"] = flat.T @ q, q.sum(0)
        back = q @ p["c"].T
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                inner = flat[a:b] @ p["w"][k]
                inner += p["wb"][k]
                q = wrong(inner, place[a:b])
                grads["w"][k], grads["wb"][k] = flat[a:b].T @ q, q.sum(0)
                back[a:b] += q @ p["w"][k].T
        dh = np.empty_like(back)
        dh[order] = back
        dh = dh.reshape(hs.shape)
        carry = np.zeros_like(h)
        dx, dg = np.empty((*before.shape, 3 * STATE), h.dtype), np.empty((streams, 3 * STATE), h.dtype)
        for t in range(len(before) - 1, -1, -1):
            old, _, z, r, c, inner = steps[t]
            d = dh[t] + carry
            own = dx[t]
            own[:, :STATE] = d * (c - old) * (z * (1 - z))
            dc = d * z * (1 - c * c)
            own[:, STATE : 2 * STATE] = dc * inner * (r * (1 - r))
            own[:, 2 * STATE :] = dc
            dg[:, : 2 * STATE], dg[:, 2 * STATE :] = own[:, : 2 * STATE], dc * r
            grads["u"] += old.T @ dg
            carry = (d * (1 - z) + dg @ p["u"].T) * ~reset[t][:, None]
        # Rows of the same word are added up side by side.
        words = before.ravel()
        order = np.argsort(words, kind="stable")
        words = words[order]
        firsts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        grads["x"][words[firsts]] = np.add.reduceat(dx.reshape(n, -1)[order], firsts)
        grads["b"] = dx.sum((0, 1))
        adam.update(p, grads)
        return h, loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.m, self.v, self.more = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(3))
        self.t, self.rate = 0, rate

    def update(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        shrink = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = np.float32(self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            m, v, more = self.m[k], self.v[k], self.more[k]
            g *= shrink
            m *= np.float32(0.9)
            m += np.multiply(g, np.float32(0.1), out=more)
            v *= np.float32(0.999)
            g *= g
            v += np.multiply(g, np.float32(0.001), out=more)
            np.sqrt(v, out=more)
            more += np.float32(1e-8)
            np.divide(m, more, out=more)
            more *= rate
            p[k] -= more
        for k in ("x", "u", "c", "w"):  # no sum over a state can overflow an exponential
            np.clip(p[k], -3, 3, out=p[k])


def trained_on(net: Gru, numbers: np.ndarray, adam: Adam) -> np.ndarray:
    """One pass over documents (word numbers, each document with its end), laid end to end into streams: as many as leave
    WINDOWS windows to each, within bounds. Returns the numbers at the end that do not fill the streams: they come next."""
    streams = max(min(32, len(numbers) // 2), min(STREAMS, len(numbers) // (WINDOW * WINDOWS)))
    if not streams:
        return numbers
    long = len(numbers) // streams
    target = numbers[: long * streams].reshape(streams, long).T
    before = np.concatenate((np.zeros((1, streams), target.dtype), target[:-1]))
    reset = before == 0
    h = np.zeros((streams, STATE), np.float32)
    for a in range(0, long, WINDOW):
        h, _ = net.train_window(h, before[a : a + WINDOW], target[a : a + WINDOW], reset[a : a + WINDOW], adam)
    return numbers[long * streams :]


def numbered(texts: pa.Array, number: dict[bytes, int], missing: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The number of each distinct word; then words, offsets and distinct words as of words_of_texts()."""
    codes, offsets, words = words_of_texts(pc.ascii_lower(texts))
    get = number.get
    return np.fromiter([get(w, missing) for w in words], np.int32, len(words)), codes, offsets, words


def with_ends(numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Word numbers of texts, one text after the other, each with its end."""
    return np.insert(numbers, offsets[1:], 0)


def trained(docs: DataFrame, net: Gru, number: dict[bytes, int], rate: float) -> Gru:
    """One round: every task trains the network on all its texts, and the weights are averaged by tokens.

    The sums are made in steps of FAN networks at most, so no task and not the driver holds more than one sum, and only
    FAN rows at most reach the driver.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net, number))
    names = sorted(net.p)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, number = sent.value
        own = Gru(start.words, {k: v.copy() for k, v in start.p.items()})
        adam, n, rest = Adam(own.p, rate), 0, np.zeros(0, np.int32)
        for batch in gathered(batches, 4000, 8 << 20):
            of_word, codes, offsets, _ = numbered(pc.fill_null(batch.column(0), ""), number)
            found = with_ends(of_word[codes], offsets)
            rest = trained_on(own, np.concatenate((rest, found)), adam)
            n += len(found)
        while len(rest) > 1:
            rest = trained_on(own, rest, adam)
        if n:
            sums = np.concatenate([(own.p[k] - start.p[k]).ravel() for k in names]) * np.float32(n)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for tokens, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(sums.as_buffer(), np.float32)
                total = more.copy() if total is None else total + more
                n += tokens
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    rows = saved(map_batches(docs.select("text"), train, "n long, sums binary"), "weights")
    while (left := rows.count()) > FAN:
        rows = saved(map_batches(rows.repartition(-(-left // FAN)), add, "n long, sums binary"), "weights")
    total, n = 0.0, 0
    for row in rows.toLocalIterator():
        total, n = total + np.frombuffer(row.sums, np.float32).astype(np.float64), n + row.n
    if not n:
        return net
    flat, out, at = total / n, {}, 0
    for k in names:
        size = net.p[k].size
        out[k] = net.p[k] + flat[at : at + size].reshape(net.p[k].shape).astype(np.float32)
        at += size
    return Gru(net.words, out)


def score_documents(net: Gru, docs: list[np.ndarray], window: int = 64, abreast: int = 1024) -> np.ndarray:
    """Natural log probability of each document (word numbers with the end), state carried over windows.

    Documents of like length run side by side; those that have ended leave the batch.
    """
    out = np.zeros(len(docs))
    order = np.argsort([-len(d) for d in docs], kind="stable")
    for a in range(0, len(docs), abreast):
        group = order[a : a + abreast]
        sizes = np.array([len(docs[i]) for i in group])
        h = np.zeros((len(group), STATE), np.float32)
        last = np.zeros(len(group), np.int64)
        for t0 in range(0, int(sizes[0]), window):
            live = int(np.searchsorted(-sizes, -t0))
            most = min(window, int(sizes[0]) - t0)
            block = np.zeros((live, most), np.int64)
            for k in range(live):
                part = docs[group[k]][t0 : t0 + most]
                block[k, : len(part)] = part
            there = np.minimum(sizes[:live] - t0, most)
            h, last = h[:live], last[:live]
            states = np.empty((most, live, STATE), np.float32)
            for t in range(most):
                h = net.step(h, last)[0]
                states[t] = h
                last = block[:, t]
            real = np.arange(most)[:, None] < there[None, :]
            logs = np.zeros((most, live))
            logs[real] = net.log_probs(states[real], block.T[real])
            out[group[:live]] += logs.sum(0)
    return out


@dataclass
class Model:
    """What scoring needs: bounded, whatever the corpus."""

    net: Gru
    number: dict[bytes, int]  # word to its number
    head: dict[bytes, int]  # word to its count, the frequent ones
    total: int  # N
    distinct: int  # V
    spare: float  # the base's mass outside the vocabulary


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over docs (text), the ends included: tasks count their part first, so a frequent word is a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for i in range(0, len(words), 20_000):
                some = words[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([held[w] for w in some], pa.int64())], ["word", "c"])
            held.clear()

        for batch in gathered(batches, 4000, 8 << 20):
            codes, _, words = words_of_texts(pc.ascii_lower(pc.fill_null(batch.column(0), "")))
            counts = np.bincount(codes, minlength=len(words)).tolist()
            held.update({w: c for w, c in zip(words, counts, strict=True) if c})
            held[END] += batch.num_rows
            if len(held) > 300_000:
                yield from rows()
        yield from rows()

    return map_batches(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn(docs: DataFrame, counts: DataFrame) -> Model:
    """docs: training documents (doc_id, text); counts: their words."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(total or 0), int(distinct or 0)
    # The head is what has at least so many tokens that HEAD words at most do: eight steps a doubling.
    step = lambda c: F.floor(F.log2(c) * 8)
    least, words = None, 0
    for row in sorted(counts.groupBy(step("c").alias("step")).count().collect(), reverse=True):
        words += row["count"]
        if words > HEAD:
            break
        least = row["step"]
    head = {bytes(r.word): r.c for r in counts.where(step("c") >= least).collect()} if least is not None else {}
    ends = counts.where(F.col("word") == F.lit(END)).first()  # the end is part of the head, however rare
    if ends:
        head[END] = ends.c
    vocabulary = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))[: MOST_WORDS - 2]
    number = {w: i + 2 for i, w in enumerate(vocabulary)} | {END: 0}
    known = np.array([head.get(END, 0), 0, *(head[w] for w in vocabulary)], np.float64)
    known[1] = total - known.sum()
    spare = 1 - sum((head.get(w, 0) + 1) / (total + distinct + 1) for w in number)
    net, part = Gru.start(known), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(sum(ROUNDS)))
    upto = 0
    for i, share in enumerate(ROUNDS):
        copies = max(1, round(total * share / sum(ROUNDS) / COPY_TOKENS))
        net = trained(docs.where((part >= upto) & (part < upto + share)).coalesce(copies), net, number, RATE / (1 + i))
        upto += share
    return Model(net, number, head, total, distinct, max(spare, 1e-12))


def half_scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document what the head and the network say, and its words beyond the head with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        ends = math.log10(m.head[END] + 1) if END in m.head else 0.0
        # Words of the head by their place in it, with what it knows of them; the last place is for all others.
        place = {w: i for i, w in enumerate(m.head)}
        head_logs_of = np.log10(np.array([*m.head.values(), 0], np.float64) + 1)
        number_of = np.array([*(m.number.get(w, 1) for w in m.head), 1], np.int32)
        for batch in gathered(batches, 4000, 8 << 20):
            docs = batch.num_rows
            at, codes, offsets, words = numbered(pc.fill_null(batch.column(1), ""), place, len(place))
            in_head, logs, of_word = at < len(place), head_logs_of[at], number_of[at]
            unknown = of_word == 1
            numbers = with_ends(of_word[codes], offsets)
            n = np.diff(offsets)
            known = of_each(in_head[codes], offsets) + (END in m.head)
            head_logs = of_each(logs[codes], offsets) + ends
            # Words beyond the head: each of a document once, with how often it has it.
            owner = np.repeat(np.arange(docs), n)
            pairs, times = np.unique((owner * len(words) + codes)[~in_head[codes]], return_counts=True)
            rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()).take(pa.array(pairs % max(1, len(words)))), pa.array(times.astype(np.int32))], ["word", "n"])
            cuts = np.searchsorted(pairs, np.arange(docs + 1) * len(words)).astype(np.int32)
            score = score_documents(m.net, np.split(numbers, offsets[1:-1] + np.arange(1, docs))) if docs else np.zeros(0)
            arrays = [
                batch.column(0), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(head_logs), pa.array(of_each((logs * unknown)[codes], offsets)),
                pa.array(score / math.log(10), pa.float64()), pa.array(of_each(unknown[codes], offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), rare).cast(kind),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "n_known", "head_logs", "unknown_logs", "model_logs", "n_unknown", "rare"])

    schema = "doc_id long, n_tokens long, n_known long, head_logs double, unknown_logs double, model_logs double, n_unknown long, rare array<struct<word:binary,n:int>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = crc32_of_id(F.col("doc_id")) % FOLDS == HELD
    training = docs.where(~held)
    counts = saved(count_words(training), "counts")
    model = learn(training, counts)
    rows = saved(half_scored(docs, model).withColumn("row_id", F.monotonically_increasing_id()), "half")
    rare = rows.select("row_id", F.explode("rare").alias("r")).select("row_id", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    tails = rare.join(counts, "word").groupBy("row_id").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_logs"))
    mass = math.log10(model.total + model.distinct + 1)
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    # An unknown word costs the model its share of the base's spare mass: (c + 1) / (N + V + 1) / spare.
    spelt = F.col("unknown_logs") + more("tail_logs") - F.col("n_unknown") * F.lit(mass + math.log10(model.spare))
    return rows.drop("rare").join(tails, "row_id", "left").select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + more("tail_logs") - F.col("n_tokens") * F.lit(mass)).alias("base_score"), (F.col("model_logs") + spelt).alias("score"),
    )


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
