"""Substring dedup by seed and extend: finds every run of ``length`` words that occurs twice.

Seeds. All k-word grams of a text are hashed; for each window of ``length`` words the least gram hash is
its anchor (winnowing with the whole window), so equal windows always share an anchor. Windows in a row
with one anchor form a run; a run is the stretch around a seed that the seed alone can vouch for. There is
about one run for every (length - k + 2) / 2 words.

Extend. Runs are joined on their anchor. Where all runs of an anchor have the same words (the inside of a
repeat), each is repeated in full. Where they differ (its ends), equal runs are repeated in full, and one
run of each kind is read again and extended word by word to both sides: the hash of each of its windows is
compared with those of the anchor's other kinds of runs. No pair of occurrences is ever listed, so a
passage that a third of all documents share costs as many rows as it has occurrences, and aggregations
combine them before the shuffle; joins back onto occurrences can be split where a key is hot.

Keep maximal repeats. A document's repeated windows are merged into maximal spans of at least ``length`` words.

Equality of windows is equality of 64-bit hashes of all their words among windows that share a 64-bit
anchor hash over k of them.

Defined cases: null text has no words; texts under ``length`` words have no repeat; rows that repeat a
doc_id and text are separate occurrences, so their windows repeat; windows may overlap their copies
("a a a a ..."); a null doc_id is an id like others; an empty table gives an empty result; input
columns keep their names, but for those of MADE, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semindex.llm.common import map_batches, saved, table, words_of
from semindex.llm.spellings import word_hashes

LENGTH, GRAM = 35, 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Most words whose hashes a task remembers.
WORDS = 300_000
KEYS = ["_si_id", "_si_tag"]
COUNT = (1 << 31) - 1


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of the base and of its inverse, as far as texts have needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, b, np.uint64))))
            self.up, self.down = grow(BASE), grow(BACK)
        return self.up[:n], self.down[:n]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Text:
    """Hashes of all word ranges of a text, from prefix sums."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        n = len(hashes)
        up, self.down = powers.upto(n + 1)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[:n], dtype=np.uint64)))

    def ranges(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return scrambled((self.sums[starts + sizes] - self.sums[starts]) * self.down[starts])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs_of(text: Text, n: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash of the words and span of each run of a text of n >= length words.

    A span is the first window << 32, a bit 31 for runs that hold their anchor twice or more (only these
    can repeat a window within themselves), and the number of windows.
    """
    grams = text.ranges(np.arange(n - k + 1), k)
    anchors = least(grams, length - k + 1)
    starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    counts = np.diff(np.concatenate((starts, [len(anchors)])))
    sizes = counts + length - 1
    own, within = anchors[starts], np.arange(length - k + 1)
    first = starts + (grams[starts[:, None] + within] == own[:, None]).argmax(1)
    ends = starts + counts - 1 + (length - k)
    last = ends - (grams[ends[:, None] - within] == own[:, None]).argmax(1)
    return own, scrambled(text.ranges(starts, sizes) + sizes.astype(np.uint64)), starts << 32 | (first != last) << 31 | counts


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def seeds(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Runs of all texts: anchor, run, document key, span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts, sizes = [], []
            for hashes in word_hashes(batch.column(2)):
                if len(hashes) < length:
                    sizes.append(0)
                    continue
                anchor, same, span = runs_of(Text(hashes, powers), len(hashes), length, k)
                parts.append((signed(anchor), signed(same), span))
                sizes.append(len(span))
            if parts:
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                anchor, same, span = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(same), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(span)], ["anchor", "run", *KEYS, "span"])

    return map_batches(docs.select(*KEYS, "text"), run, "anchor long, run long, _si_id long, _si_tag long, span long")


def extended(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The windows of the asked runs, one by one: anchor, window hash, document key, place (first word)."""
    fields = [*docs.columns, "_si_asked"]
    at = [fields.index(c) for c in (*KEYS, "text", "_si_asked")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = WordHashes(), Powers()
        for batch in batches:
            ids, tags, texts, asked = (batch.column(i) for i in at)
            anchors, hashes, owners, places = [], [], [], []
            for i in range(batch.num_rows):
                text = None
                for want in asked[i].as_py():
                    text = text or Text(known.of(words_of(texts[i].as_py())), powers)
                    starts = (want["span"] >> 32) + np.arange(want["span"] & COUNT)
                    anchors.append(np.full(len(starts), want["anchor"]))
                    hashes.append(signed(text.ranges(starts, length)))
                    owners.append(np.full(len(starts), i))
                    places.append(starts)
            if anchors:
                owner = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(hashes)), ids.take(owner), tags.take(owner), pa.array(np.concatenate(places))], ["anchor", "window", *KEYS, "place"])

    wanted = asked.groupBy(*KEYS).agg(F.collect_set(F.struct("anchor", "span")).alias("_si_asked"))
    return map_batches(docs.join(wanted, KEYS).select(*fields), run, "anchor long, window long, _si_id long, _si_tag long, place long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """For keyed documents with a repeat: key and packed spans of repeated windows. A document has no more of them than words."""
    found = seeds(docs, length, k)
    # Combined before the shuffle: one row per anchor and task.
    loops = F.shiftright("span", 31).bitwiseAND(F.lit(1))
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.max(loops).alias("loops"), F.min("run").alias("a"), F.max("run").alias("b")).where("n + loops > 1")
    # What occurrences are joined with is written first, so that both sides are shuffled for the join and Spark splits a hot key.
    shared = saved(shared.select("anchor", F.expr("n > 1 AND a = b").alias("inside")), "anchors")
    held = saved(found.join(shared, "anchor"), "seeds")
    whole = held.where("inside").select(*KEYS, "span")
    edge = held.where("NOT inside")
    kinds = saved(edge.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "span")).alias("one")), "kinds")
    twice = edge.join(kinds.where("n > 1").select("anchor", "run"), ["anchor", "run"], "left_semi").select(*KEYS, "span")
    windows = saved(extended(docs, kinds.select("anchor", "one.*"), length), "windows")
    again = saved(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window"), "again")
    single = windows.join(again, ["anchor", "window"], "left_semi").select(*KEYS, (F.col("place") * F.lit(1 << 32) + 1).alias("span"))
    return whole.unionByName(twice).unionByName(single).groupBy(*KEYS).agg(F.collect_set("span").alias("_si_spans"))


def maximal(n: int, spans: list[int] | None, length: int) -> np.ndarray:
    """Which of n words the windows cover; ``spans`` are packed."""
    covered = np.zeros(n + 1, np.int64)
    if spans:
        packed = np.array(spans, np.int64)
        starts, counts = packed >> 32, packed & COUNT
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + counts + length - 1, -1)
    return np.cumsum(covered)[:n] > 0


MADE = "n_words long, n_removed long, kept_text string, repeats array<struct<begin:int,end:int>>"


def strip_repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """docs (doc_id, text, ...) with MADE: counts, the words outside repeats joined by spaces, the maximal repeats as word ranges."""
    made = T.StructType.fromDDL(MADE)
    docs = docs.drop(*made.names)
    names, text_at = docs.columns, docs.columns.index("text")
    # Inside, columns go by their places, so no name of the input meets one of ours.
    key = {"_si_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_si_tag": F.xxhash64("text")}
    base = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), *(v.alias(k) for k, v in key.items()))
    spans = repeated_spans(base.select(*KEYS, F.col(f"c{text_at}").alias("text")), length, k)
    fields = [f"c{i}" for i in range(len(names))] + ["_si_spans"]
    joined = base.join(spans, KEYS, "left").select(*fields)
    schema = T.StructType([*docs.schema.fields, *made.fields])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(text_at), batch.column(len(fields) - 1), strict=True):
                words = words_of(t.as_py())
                gone = maximal(len(words), s.as_py(), length)
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(turns) else words
                ranges = [{"begin": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                rows.append((len(words), len(words) - len(left), b" ".join(left).decode(), ranges))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), kind), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema.names)

    return map_batches(joined, run, schema)


def op3_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeats; a text that has none, null included, stays as it is."""
    out = strip_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
