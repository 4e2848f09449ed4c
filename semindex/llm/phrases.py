"""Phrase collocation mining: frequent word n-grams, scored by how far their parts keep together.

Words are dictionary-encoded in two steps, so that no task needs the whole dictionary. One Python pass cuts the
texts of a task into chunks of about CHUNK_BYTES, each with a dictionary of its own: the chunk's words as places in
it, 0 where a piece ends, and the chunk's distinct words with their counts. These counts, summed by Spark, give the
global dictionary of words found MIN_COUNT times or more; joined back, a chunk learns the global numbers of its own
words, and all others become breaks too, as no frequent phrase can hold them.

N-grams of numbers are fixed-width keys of 12 bytes (three numbers, the third 0 for two words). A chunk's keys are
radix sorted, equal ones run-length counted, and dealt to key ranges of about equal mass, which follow from the
words' own counts; a range's task radix sorts and run-length counts again. What is shuffled is a block of sorted keys,
by byte planes, for each chunk and range. A phrase of the whole corpus meets its task as one key of each chunk.

Scores are exact: products are decimals of 38 digits, division rounds down.

Defined cases: null text counts as empty, null lang as ``und``; repeated rows count as often as they stand; an empty
table, or one without frequent phrases, gives no rows; other columns are ignored. A piece, as long as it may be,
stays in one chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semindex.llm.common import map_batches, saved, table

MIN_COUNT, TOP, INNER_PERCENT = 10, 2000, 50
#: Bytes of text in a chunk and held in all open chunks; keys of a range and keys held before they are counted; words of a bucket;
#: groups of tasks whose best are picked before a lang's.
CHUNK_BYTES, OPEN_BYTES, RANGE_KEYS, HELD_KEYS, BUCKET_WORDS, GROUPS = 4 << 20, 24 << 20, 3_000_000, 4_000_000, 50_000, 64
BREAK = b"\xff"  # no byte of UTF-8
#: Ends of pieces become BREAK; line breaks and their like are among them, so that split() cuts at spaces and tabs only.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)


class Places(dict):
    """Places of a chunk's words, from 1, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self) + 1
        return out


class Chunk:
    def __init__(self) -> None:
        self.places, self.parts, self.size = Places(), [], 0

    def add(self, words: list[bytes], size: int) -> None:
        self.parts.append(np.fromiter(map(self.places.__getitem__, words), np.int32, len(words)))
        self.size += size

    def row(self, lang: str) -> pa.RecordBatch:
        at, mark = np.concatenate(self.parts), self.places[BREAK]
        counts = np.bincount(at, minlength=len(self.places) + 1)[1:]
        at[at == mark] = 0
        counts[mark - 1] = 0  # the mark keeps its place, but is no word
        words = pa.array([b"" if w == BREAK else w for w in self.places], pa.binary()).cast(pa.string())
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([lang]), pa.array([at.tobytes()], pa.binary()), whole(words), whole(pa.array(counts, pa.int64()))], CHUNK)


CHUNK = ["chunk", "lang", "places", "words", "counts"]


def word_lists(text: str, most: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text, lower-cased A-Z, with a BREAK after each piece, and their bytes: in lists of about ``most`` bytes that end with a BREAK."""
    data = text.encode().lower().translate(ENDS) + BREAK
    a = 0
    while a < len(data):
        b = len(data) if len(data) - a <= most else data.index(BREAK, a + most - 1) + 1
        yield data[a:b].replace(BREAK, b" \xff ").split(), b - a
        a = b


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (text, lang): (chunk, lang, places int32s, words, counts). Names are new in each attempt of a task: save it before use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Chunk] = {}
        total = 0
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                for words, size in word_lists(text, chunk_bytes) if text else ():
                    chunk = held.get(lang) or held.setdefault(lang, Chunk())
                    chunk.add(words, size)
                    total += size
                    if chunk.size >= chunk_bytes:
                        total -= chunk.size
                        yield held.pop(lang).row(lang)
                if total >= OPEN_BYTES:
                    yield from (c.row(name) for name, c in held.items())
                    held, total = {}, 0
        yield from (c.row(name) for name, c in held.items())

    return map_batches(docs.select("text", F.coalesce("lang", F.lit("und"))), run, "chunk string, lang string, places binary, words array<string>, counts array<long>")


def dictionary(words: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, int]:
    """words (lang, word, n): frequent ones as (lang, word, id from 1, f, pos, share), and how many occurrences they have. ``pos``
    and ``share`` are the parts of all occurrences before a word and of the word. Ids are prefix sums over buckets of hashes."""
    found = saved(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), "frequent")
    n_words, total = found.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    if n_words >= 1 << 32:
        raise ValueError("more than 32-bit word numbers: raise min_count")
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(-(-n_words // BUCKET_WORDS) or 1)).alias("_b")
    found = found.select("*", bucket)
    sizes = sorted(tuple(r) for r in found.groupBy("_b").agg(F.count("*"), F.sum("f")).collect())  # a row for BUCKET_WORDS words
    ids, masses = np.cumsum([0] + [n for _, n, _ in sizes]), np.cumsum([0] + [f for _, _, f in sizes])
    bases = found.sparkSession.createDataFrame([(b, int(i), int(m)) for (b, _, _), i, m in zip(sizes, ids, masses, strict=False)], "_b long, _id long, _f long")
    order = Window.partitionBy("_b").orderBy("lang", "word")
    placed = found.withColumns({"_no": F.row_number().over(order), "_upto": F.sum("f").over(order)}).join(F.broadcast(bases), "_b")
    pos, share = (F.col("_f") + F.col("_upto") - F.col("f")) / F.lit(max(total, 1)), F.col("f") / F.lit(max(total, 1))
    return saved(placed.select("lang", "word", (F.col("_id") + F.col("_no")).alias("id"), "f", pos.alias("pos"), share.alias("share")), "dictionary"), int(total)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of the columns of ``keys`` (3 x n, uint32) as 12-byte keys: least digit of 16 bits first, each pass a stable radix sort."""
    order = None
    for column in keys[::-1]:
        for digit in (column.astype(np.uint16), (column >> np.uint32(16)).astype(np.uint16)):
            if len(digit) and (digit != digit[0]).any():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(keys.shape[1]) if order is None else order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the number of each or the sum of its counts."""
    if not keys.shape[1]:
        return keys, np.zeros(0, np.int64)
    order = radix_order(keys)
    keys = keys[:, order]
    starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
    sums = np.diff(np.append(starts, keys.shape[1])) if counts is None else np.add.reduceat(counts[order], starts)
    return keys[:, starts], sums


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts (below 2**32, as of one chunk) by byte planes."""
    rows = np.ascontiguousarray(np.concatenate([keys, counts[None].astype(np.uint32)]))
    return zstandard.ZstdCompressor(level=1).compress(rows.view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1).tobytes())


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(4, 4, -1)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32)[:, :, 0]
    return rows[:3], rows[3].astype(np.int64)


def keys_of(numbers: np.ndarray) -> np.ndarray:
    """All keys of two and three numbers in a row, none of them 0."""
    held = numbers > 0
    two = held[:-1] & held[1:]
    three = two[:-1] & held[2:]
    i, j = np.flatnonzero(two), np.flatnonzero(three)
    pairs = np.stack([numbers[i], numbers[i + 1], np.zeros(len(i), np.uint32)])
    return np.concatenate([pairs, np.stack([numbers[j], numbers[j + 1], numbers[j + 2]])], axis=1)


def grams(chunks: DataFrame, words: DataFrame, total: int, min_count: int = MIN_COUNT) -> DataFrame:
    """(g0, g1, g2, a): n-grams of two (g2 is 0) and three words that are found ``min_count`` times or more."""
    ranges = max(1, -(-2 * total // RANGE_KEYS))
    own = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    numbers = own.join(words, ["lang", "word"]).select(F.col("chunk").alias("_chunk"), (F.col("place") + 1).alias("place"), "id", "pos", "share")

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        columns = {name: right.column(name).to_numpy() for name in ("place", "id", "pos", "share")}
        order = np.argsort(columns["id"], kind="stable")
        place, number, pos, share = (np.append(0, columns[name][order]) for name in ("place", "id", "pos", "share"))
        rank = np.zeros(int(place.max()) + 1, np.uint32)  # the chunk's frequent words by their number, from 1: fewer digits to sort by
        rank[place] = np.arange(len(place))
        number = number.astype(np.uint32)
        for places in left.column("places"):
            at = np.frombuffer(places.as_py(), np.int32)
            local = rank[np.where(at < len(rank), at, 0)]
            keys, counts = run_lengths(keys_of(local))
            x = pos[keys[0]] + share[keys[0]] * (pos[keys[1]] + share[keys[1]] * pos[keys[2]])
            part = np.minimum((x * ranges).astype(np.int64), ranges - 1)
            order = np.argsort(part, kind="stable")
            keys, counts, part = number[keys[:, order]], counts[order], part[order]
            if not len(part):
                continue
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
                out[0].append(int(part[a]))
                out[1].append(packed(keys[:, a:b], counts[a:b]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["range", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return run_lengths(np.concatenate([k for k, _ in held], axis=1), np.concatenate([c for _, c in held]))

        def out() -> pa.RecordBatch:
            keys, counts = merged()
            often = counts >= min_count
            return pa.RecordBatch.from_arrays([pa.array(x[often].astype(np.int64)) for x in (*keys, counts)], ["g0", "g1", "g2", "a"])

        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and part != now:
                    yield out()
                    held, n = [], 0
                now = part
                held.append(unpacked(block.as_py()))
                n += len(held[-1][1])
                if n > HELD_KEYS:
                    held = [merged()]
                    n = max(0, len(held[0][1]) - HELD_KEYS // 2)
        if held:
            yield out()

    blocks = chunks.select("chunk", "places").groupBy("chunk").cogroup(numbers.groupBy("_chunk")).applyInArrow(encode, "range long, block binary")
    return map_batches(blocks.repartition(ranges, "range").sortWithinPartitions("range"), count, "g0 long, g1 long, g2 long, a long")


def first_of(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """rows (lang, ...) with ``rank``, the first ``top`` of each lang. In two steps, so that the last one reads GROUPS times ``top`` rows
    of a lang at most, however many tasks there are."""
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    some = rows.withColumn("_group", F.spark_partition_id() % GROUPS).withColumn("rank", place("_group")).where(F.col("rank") <= top).drop("rank", "_group")
    return some.withColumn("rank", place()).where(F.col("rank") <= top)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, inner_percent: int = INNER_PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (text, lang): (lang, rank, phrase, a, l, r, n, score), the ``top`` phrases of each lang."""
    chunks = saved(chunked(docs, chunk_bytes), "chunks")
    own = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n")).where("n > 0")
    totals = own.groupBy("lang").agg(F.sum("n").alias("n"))
    words, total = dictionary(own, min_count)
    found = saved(grams(chunks, words, total, min_count), "grams")
    big = lambda c: F.col(c).cast("decimal(15,0)")
    score = lambda left, right: F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), big(left) * big(right))
    word = lambda i, f: words.select(F.col("id").alias(f"g{i}"), F.col("f").alias(f))
    first = words.select(F.col("id").alias("g0"), F.col("f").alias("l"), "lang")
    pairs = saved(found.where("g2 = 0").join(first, "g0").join(word(1, "r"), "g1").select("lang", "g0", "g1", "a", "l", "r"), "pairs")
    before = pairs.select("g0", "g1", "lang", F.col("l").alias("_l1"), F.col("a").alias("_l2"))
    after = pairs.select(F.col("g0").alias("g1"), F.col("g1").alias("g2"), F.col("a").alias("_r1"), F.col("r").alias("_r2"))
    three = found.where("g2 > 0").join(before, ["g0", "g1"]).join(after, ["g1", "g2"]).withColumns({"_s1": score("_l1", "_r1"), "_s2": score("_l2", "_r2")})
    late = F.col("_s2") < F.col("_s1")  # the lower score, the earlier cut among equal ones
    pick = lambda x: F.when(late, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    three = three.select("lang", "g0", "g1", "g2", "a", pick("_l").alias("l"), pick("_r").alias("r"), pick("_s").alias("score"))
    around = three.select("g0", "g1", "a").unionByName(three.select(F.col("g1").alias("g0"), F.col("g2").alias("g1"), "a")).groupBy("g0", "g1").agg(F.max("a").alias("_most"))
    alone = F.col("_most").isNull() | (100 * F.col("_most") < inner_percent * F.col("a"))
    two = pairs.join(around, ["g0", "g1"], "left").where(alone).select("lang", "g0", "g1", F.lit(0).cast("long").alias("g2"), "a", "l", "r", score("l", "r").alias("score"))
    scored = saved(two.unionByName(three), "scored")
    # The last place's score and count first; only what is not below them is spelt out.
    last = first_of(scored.select("lang", "score", "a"), top, F.desc("score"), F.desc("a")).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("_last"))
    best = scored.join(last, "lang").where(F.struct("score", "a") >= F.col("_last"))
    for i in range(3):
        best = best.join(words.select(F.col("id").alias(f"g{i}"), F.col("word").alias(f"_w{i}")), f"g{i}", "left")
    named = best.withColumn("phrase", F.concat_ws(" ", "_w0", "_w1", "_w2"))
    ranked = first_of(named.select("lang", "phrase", "a", "l", "r", "score"), top, F.desc("score"), F.desc("a"), F.asc("phrase"))
    return ranked.withColumn("rank", F.col("rank").cast("long")).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents").select("text", "lang"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)
), t AS (
  SELECT lang, unnest(w) AS w0, unnest(list_concat(w[2:], [NULL])) AS w1, unnest(list_concat(w[3:], [NULL, NULL])[1:len(w)]) AS w2 FROM w WHERE len(w) > 0
), one AS (
  SELECT lang, w0, count(*)::hugeint AS a FROM t GROUP BY ALL
), two AS (
  SELECT lang, w0, w1, count(*)::hugeint AS a FROM t WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), three AS (
  SELECT lang, w0, w1, w2, count(*)::hugeint AS a FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), totals AS (
  SELECT lang, sum(a)::bigint AS n FROM one GROUP BY lang
), two_scored AS (
  SELECT t.*, l.a AS l, r.a AS r, (1000000 * t.a * t.a) // (l.a * r.a) AS score FROM two t JOIN one l ON l.lang = t.lang AND l.w0 = t.w0 JOIN one r ON r.lang = t.lang AND r.w0 = t.w1
), cuts AS (
  SELECT t.*, b.l AS l1, e.a AS r1, (1000000 * t.a * t.a) // (b.l * e.a) AS s1, b.a AS l2, e.r AS r2, (1000000 * t.a * t.a) // (b.a * e.r) AS s2
  FROM three t JOIN two_scored b ON b.lang = t.lang AND b.w0 = t.w0 AND b.w1 = t.w1 JOIN two_scored e ON e.lang = t.lang AND e.w0 = t.w1 AND e.w1 = t.w2
), around AS (
  SELECT lang, w0, w1, max(a) AS most FROM (SELECT lang, w0, w1, a FROM three UNION ALL SELECT lang, w1, w2, a FROM three) GROUP BY ALL
), kept AS (
  SELECT lang, w0 || ' ' || w1 AS phrase, a, l, r, score FROM two_scored LEFT JOIN around USING (lang, w0, w1) WHERE coalesce(100 * most < {INNER_PERCENT} * a, true)
  UNION ALL SELECT lang, w0 || ' ' || w1 || ' ' || w2, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts
)
SELECT lang, row_number() OVER o AS rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n, score::bigint AS score
FROM kept JOIN totals USING (lang) WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= {TOP}"""
