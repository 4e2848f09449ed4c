"""Embedding through a pluggable vectorized function, batches, token limits."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semindex.functions import columns as C
from semindex.functions import constants as K
from semindex.sources.shared import in_ranges, saved, small_batches

#: Texts to vectors, a row each.
Embedder = Callable[[list[str]], np.ndarray]


def with_retries(call: Callable[[], np.ndarray], tries: int = K.RETRIES, first_ms: int = K.RETRY_MS) -> np.ndarray:
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(first_ms * 2**n / 1000)
    raise ValueError("tries must be positive")


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def dealt(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df in even parts, at least one for each core: a table of few row groups would leave the others idle while Python works on it."""
    return df.repartition(partitions or max(df.sparkSession.sparkContext.defaultParallelism, 1))


def prepared(text_col: str, prefix: str | None = None) -> Column:
    """What is sent of a text: trimmed, with its prefix; null for blank ones and those over the item limit."""
    text = C.apply_prefix(C.trimmed(text_col), prefix)
    return F.when((F.length(text) > 0) & (C.est_tokens(text) <= K.MAX_ITEM_TOKENS), text)


def embed(df: DataFrame, text_col: str, embedder: Embedder, batch_size: int = K.BATCH_BLOCKS, prefix: str | None = None) -> DataFrame:
    """df with ``vector``. The trimmed text is embedded, the column stays as it is; a vector stays with its row.

    Blank texts and those over the item limit get a null vector.
    """
    df = df.drop("vector")
    ready = df.withColumn("_text", prepared(text_col, prefix))
    names = [*df.columns, "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            wanted = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for a in range(0, len(wanted), batch_size):
                some = wanted[a : a + batch_size]
                for i, v in zip(some, with_retries(lambda some=some: embedder([texts[i] for i in some])), strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], names)

    small_batches(df.sparkSession)
    return ready.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


class WordPlaces(dict):
    """A word's place by its hash, remembered for WORDS words."""

    WORDS = 200_000

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= self.WORDS:
            self.clear()
        at = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return at

    def __reduce__(self):
        return WordPlaces, (self.dim,)


def hashing_embedder(dim: int = 64) -> Embedder:
    """Offline and deterministic: counts of lower-case words by a hash of the word, at unit length."""

    known = WordPlaces(dim)  # one for each worker that unpickles it

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            places = [known[word] for word in text.lower().split(" ") if word]
            row += np.bincount(np.array(places, np.int64), minlength=dim)
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)

    return run


def decode_vectors(df: DataFrame, column: str) -> DataFrame:
    """base64 of little-endian float32 values, as some services send vectors, to array<float>."""
    names, at = df.columns, df.columns.index(column)
    fields = [T.StructField(column, T.ArrayType(T.FloatType())) if f.name == column else f for f in df.schema.fields]
    raw = df.withColumn(column, F.unbase64(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([None if v is None else np.frombuffer(v, "<f4") for v in batch.column(at).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([vectors if i == at else c for i, c in enumerate(batch.columns)], names)

    return raw.mapInArrow(run, T.StructType(fields))


def other_dimension(vector: Column | str, dim: int) -> Column:
    """Aggregate: whether any vector has another dimension."""
    return F.coalesce(F.bool_or(F.size(C.col(vector)) != dim), F.lit(False))


def needs_rebuild(points: DataFrame, dim: int) -> bool:
    return points.agg(other_dimension("vector", dim)).first()[0]


def batch_numbers(blocks: DataFrame, order: list[str], batch_size: int = K.BATCH_BLOCKS) -> DataFrame:
    """Numbers batches per file group for plans: within (collection_id, file_path) in line order.

    A number over a whole collection would need its blocks in one task; files are the unit here, and the
    estimate for a collection is ceil(blocks / batch_size).
    """
    place = F.row_number().over(Window.partitionBy("collection_id", "file_path").orderBy(*order))
    return blocks.withColumn("batch_no", F.floor((place - 1) / batch_size).cast("long"))


def jumps(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item as the first of a batch: how many batches follow it to the end, what the last one holds; and prefix sums. Pointers to
    the first item that no longer fits are composed by doubling."""
    n = len(tokens)
    upto = np.concatenate([[0], np.cumsum(tokens)])
    after = np.searchsorted(upto, upto[:n] + most, side="right") - 1
    some = np.append(np.flatnonzero(tokens > 0), n - 1)
    after = np.maximum(after, np.minimum(some[np.searchsorted(some[:-1], np.arange(n))] + 1, n))  # a batch that holds nothing yet takes any item
    to = np.append(after, n)
    count, start = np.append((to[:n] < n).astype(np.int64), 0), np.where(to < n, to, np.arange(n + 1))
    while (start[start] != start).any():
        count, start = count + count[start], start[start]
    return count[:n], upto[n] - upto[start[:n]], upto


def summary(tokens: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(least, held, batches, total): what a range of a key makes of the sum that it is handed: of the rows whose ``least`` it reaches, the
    one with the greatest tells the sum handed on and the batches opened; below all of them the range's total is added."""
    after, left, upto = jumps(tokens, most)
    total = int(upto[-1])
    out = [(0, int(left[0]), int(after[0]), total)]
    closes = np.flatnonzero((tokens > 0) & (upto[:-1] < most))  # items that may be the first not to fit
    least = np.maximum(most - upto[closes + 1] + 1, 1)
    first = np.concatenate([[True], least[1:] < least[:-1]]) if len(least) else np.zeros(0, bool)
    return out + [(int(h), int(left[i]), int(after[i]) + 1, total) for h, i in zip(least[first], closes[first], strict=True)] + [(-1, 0, 0, total)]


def token_batches(items: DataFrame, most: int = K.MAX_BATCH_TOKENS, item_most: int = K.MAX_ITEM_TOKENS, ranges: int | None = None) -> DataFrame:
    """items (batch_key, seq, tokens) with batch_no: greedy packing in order of seq; items over the limit get null.

    A new batch opens when the sum would pass the limit. Items lie in ranges of (key, seq); each range tells what it makes of any
    sum that it is handed (summary(), a row for each item that may close the first batch), a fold over these rows gives each
    range its sum and number, and then all ranges are packed side by side, those of one key too.
    """
    names = ["batch_key", "seq", "tokens", "batch_no"]
    slim = items.select(F.col("batch_key").cast("string"), F.col("seq").cast("long"), F.col("tokens").cast("long"))
    fits = in_ranges(slim.where(F.col("tokens") <= item_most), "batch_key", "seq", "tokens", ranges=ranges)
    shape = "part int, batch_key string, least long, held long, batches long, total long"

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows = summary(np.concatenate(held), most)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(rows), pa.int32()), pa.array([now[1]] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], [c.split()[0] for c in shape.split(", ")])

        now, held = None, []
        for batch in batches:
            parts, keys, tokens = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or parts[i] != parts[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and (parts[a], keys[a]) != now:
                        yield out()
                        held = []
                    now = (parts[a], keys[a])
                    held.append(tokens[a:b])
        if held:
            yield out()

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Along the ranges of each key: the sum and the number that each is handed."""
        key, part, h, no, rows = object(), None, 0, 0, []

        def step() -> None:
            nonlocal h, no
            _, out, more, _ = max(r for r in rows if (r[0] == 0 if h == 0 else 0 < r[0] <= h or r[0] == -1))
            if h and max(r[0] for r in rows if 0 < r[0] <= h or r[0] == -1) == -1:
                out = h + rows[0][3]
            h, no, rows[:] = out, no + more, []

        for batch in batches:
            made = []
            for p, k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, part, h, no, rows = k, None, 0, 0, []
                if p != part:
                    if rows:
                        step()
                    part = p
                    made.append((p, k, h, no))
                rows.append(tuple(row))
            columns = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "batch_key", "_h", "_no"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, no = None, 0, 0
        for batch in batches:
            numbers = []
            for p, k, n, h, first in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if (p, k) != at:
                    at, held, no = (p, k), h, first
                if held and held + n > most:
                    held, no = 0, no + 1
                held += n
                numbers.append(no)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(numbers, pa.int64())], names)

    told = fits.repartition("part", "batch_key").sortWithinPartitions("part", "batch_key", "place").select("part", "batch_key", "tokens").mapInArrow(summaries, shape)
    handed = saved(told.repartition("batch_key").sortWithinPartitions("batch_key", "part", "least").mapInArrow(carry, "part int, batch_key string, _h long, _no long"), "carries")
    carried = fits.alias("i").join(handed.alias("c"), (F.col("i.part") == F.col("c.part")) & F.col("i.batch_key").eqNullSafe(F.col("c.batch_key")))
    rows = carried.select("i.part", "i.batch_key", "seq", "tokens", "_h", "_no", "place").repartition("part", "batch_key").sortWithinPartitions("part", "batch_key", "place")
    packed = rows.drop("place").mapInArrow(pack, "batch_key string, seq long, tokens long, batch_no long")
    over = slim.where(F.col("tokens").isNull() | (F.col("tokens") > item_most)).withColumn("batch_no", F.lit(None).cast("long"))
    return packed.unionByName(over)


def token_usage(items: DataFrame) -> DataFrame:
    return items.groupBy("batch_key").agg(F.sum("tokens").alias("prompt_tokens"), F.count("*").alias("n_items"))
