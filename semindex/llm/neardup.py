"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Sketch. A text's word grams are labelled with their occurrence number; each seeded hash takes the two
smallest labelled grams and keeps them in text order. Two texts agree on a sketch with about the square of
their gram similarity, and only if the order agrees too, which is what edit similarity asks for. Grams of
five words in 8 sketches find texts that share most of them; but 16 edits spread over 100 words leave few
of these, so 40 sketches hold grams of three words. Of pairs at the threshold, 20 edits in 100 words,
at least nine in ten meet, however the edits are spread (0.93 where they are spread evenly).

Buckets. Equal texts (equal word sequences) are collapsed first and stand for one node. A bucket's centre is
its smallest member; each node is compared with the centre that it shares most buckets with, and the links
found make the first classes. Then every pair of a bucket's members that are in different classes is taken
up, whatever the bucket's size and whether a member has matched or not: lengths and counts of words in a few
bins, which are slim, tell first who has no partner in a bucket at all, as is so wherever unlike texts have a phrase
in common; of the others lengths and counts in BINS bins exclude most pairs by proof, and what is left is verified,
nearest first, as each link that joins two classes settles all pairs between them. So the classes are those of
all pairs that share a bucket; no pair of a bucket is lost.

Verification. Word-level edit distance, exact up to the most edits that similarity 1 - edits / longer length >= 0.8
allows, after a multiset bound: a column of the table of distances at a time, as the bits of a number; in texts too long
for that, furthest-reaching points per diagonal and then a band.

Classes are the connected components of verified links, by alternating large-star and small-star steps on
tables; class_id is the smallest doc_id of a class, of those that no other class has if there are any.

Defined cases: null text counts as empty; texts of equal words are copies, empty ones too; texts under 5
words have no sketch, so only their copies are found; repeated rows share a class; texts are the nodes, so
unlike texts of one doc_id, or of none, are in classes of their own; a null doc_id is the last to name a class,
and a class without any other has the null class_id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import map_batches, saved, shared_folder, table, words_of
from semindex.llm.spellings import word_hashes
from semindex.llm.substring import Powers, Text, WordHashes, scrambled, signed
from semindex.sources.corpus import file_system

#: Words of a gram and number of sketches, for each kind; grams of a sketch; least similarity.
KINDS, SIZE, SIMILAR = ((5, 8), (3, 40)), 2, 0.8
GRAM, SKETCHES = KINDS[0][0], sum(n for _, n in KINDS)
NULL_ID = -(2**63)
#: Members of a bucket that meet at once; bins that words are counted in to exclude pairs, and how many they are first added up to; tasks
#: that pairs of slices are dealt to, at most.
SLICE, BINS, COARSE, MOST_TASKS = 1024, 2048, 128, 4096
#: Bins of the counts that go with each member of a bucket; words of a text whose distances are held as bits, and up to which that takes
#: less time than to look for an alignment; pairs whose nodes are broadcast, and links that one task joins, at most.
SLIM, MOST_BITS, SHORT, FEW = 64, 8192, 400, 50_000
#: What names a row's text: its id, never null, and a digest of the text as it is.
IDS = ["coalesce(cast(doc_id AS long), -9223372036854775807 - 1) AS _id", "unhex(md5(cast(coalesce(text, '') AS binary))) AS mark"]
#: Grams that are hashed at once.
BLOCK = 1 << 11
SEEDS = scrambled(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = scrambled(SEEDS) | np.uint64(1)
MOST = np.uint64(2**64 - 1)
SKETCH = "_id long, mark binary, digest binary, n int, slim binary, keys array<long>"


def least_grams(grams: np.ndarray, seeds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each seed: the grams whose labelled hashes are least, in text order."""
    n, every = len(grams), np.arange(len(seeds))
    order = np.argsort(grams, kind="stable")
    fresh = np.concatenate(([True], grams[order[1:]] != grams[order[:-1]]))
    number = np.empty(n, np.uint64)
    number[order] = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    labelled = scrambled(grams + number * np.uint64(0xD6E8FEB86659FD93))
    least, at = np.zeros((len(seeds), 0), np.uint64), np.zeros((len(seeds), 0), np.int64)  # per seed, the smallest hashes so far and their places
    for i in range(0, n, BLOCK):
        x = (labelled[None, i : i + BLOCK] ^ seeds[:, None]) * factors[:, None]
        for _ in range(min(x.shape[1], SIZE)):  # each pass finds the least that is left
            place = x.argmin(1)
            least, at = np.concatenate((least, x[every, place, None]), 1), np.concatenate((at, i + place[:, None]), 1)
            x[every, place] = MOST
        keep = np.argsort(least, axis=1, kind="stable")[:, :SIZE]
        least, at = np.take_along_axis(least, keep, 1), np.take_along_axis(at, keep, 1)
    key = seeds
    for g in grams[np.sort(at, axis=1)].T:  # in text order
        key = scrambled(key * np.uint64(31) + g)
    return key


def sketches(hashes: np.ndarray, powers: Powers) -> np.ndarray:
    """A key for each sketch of a text's word hashes; keys of different sketches never mean the same."""
    if len(hashes) < GRAM:
        return np.zeros(0, np.int64)
    text, keys, first = Text(hashes, powers), [], 0
    for gram, n in KINDS:
        grams = text.ranges(np.arange(len(hashes) - gram + 1), gram)
        keys.append(least_grams(grams, SEEDS[first : first + n], FACTORS[first : first + n]))
        first += n
    return signed(np.concatenate(keys))


def sketched(docs: DataFrame) -> DataFrame:
    """SKETCH of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for batch in batches:
                digests, sizes, slim, keys = [], [], [], []
                for hashes in word_hashes(batch.column(2)):
                    sizes.append(len(hashes))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    slim.append(binned(hashes, SLIM))
                    keys.append(sketches(hashes, powers))
                ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64))
                arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(slim, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "mark", "digest", "n", "slim", "keys"])

    return map_batches(docs.selectExpr(*IDS, "text"), run, SKETCH)


def binned(hashes: np.ndarray, bins: int) -> bytes:
    """Counts of a text's words in bins, each up to 255."""
    return np.minimum(np.bincount((hashes % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def counted(texts: DataFrame) -> DataFrame:
    """(node, bins): counts of a text's words in BINS bins, each up to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [binned(hashes, BINS) for hashes in word_hashes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins, pa.binary())], ["node", "bins"])

    return map_batches(texts.select("node", "text"), run, "node long, bins binary")


def edits(a: list, b: list, most: int) -> int | None:
    """Word-level edit distance, or None if it is over ``most``."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    start = 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[start:n], b[start:m]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else None
    ca = Counter(a)
    ca.subtract(b)
    gone = sum(v for v in ca.values() if v > 0)
    if max(gone, gone - n + m) > most:
        return None
    if min(n, m) - start <= MOST_BITS:
        return edits_by_bits(*sorted((a, b), key=len), most)
    found = edits_by_diagonal(a, b, min(most, 64))
    return found if found is not None or most <= 64 else edits_in_band(np.array(a), np.array(b), most)


def edits_by_bits(a: list, b: list, most: int) -> int | None:
    """The same distance by columns: the steps up and down between the distances of a's beginnings from those of b are the bits of two numbers."""
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, out = every, 0, len(a)
    for left, word in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = places.get(word, 0)
        level = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (every & ~(level | up)), up & level
        if right_up & last:
            out += 1
        elif right_down & last:
            out -= 1
        if out - left > most:  # each word to come takes off one at most
            return None
        right_up, right_down = right_up << 1 | 1, right_down << 1
        up, down = every & (right_down | ~(level | right_up)), every & right_up & level
    return out if out <= most else None


def edits_by_diagonal(a: list, b: list, most: int) -> int | None:
    """Furthest reaching points, one diagonal after the other: best for few edits."""
    n, m = len(a), len(b)
    end, reach = m - n, {}
    for e in range(most + 1):
        now = {}
        for d in range(max(-e, -n), min(e, m) + 1):
            i = 0 if not e else max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            now[d] = i
        if now.get(end, -1) >= n:
            return e
        reach = now
    return None


def edits_in_band(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The same distance row by row over a band of diagonals: best for many edits."""
    n, m = len(a), len(b)
    width = 2 * most + 1
    offsets = np.arange(width) - most
    row = np.where((offsets >= 0) & (offsets <= m), offsets, most + 1)
    steps = np.arange(width)
    for i in range(1, n + 1):
        j = i + offsets
        inside = (j >= 1) & (j <= m)
        differ = np.ones(width, np.int64)
        differ[inside] = b[j[inside] - 1] != a[i - 1]
        new = np.minimum(np.where(inside, row + differ, most + 1), np.concatenate((row[1:], [most + 1])) + 1)
        new[j == 0] = i
        new = np.where((j >= 0) & (j <= m), new, most + 1)
        row = np.minimum(np.minimum.accumulate(new - steps) + steps, most + 1)
        if row.min() > most:
            return None
    out = int(row[m - n + most])
    return out if out <= most else None


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of one alignment, so no fewer than the distance: along words that both texts have once, in order;
    between two of them stretches of equal length are compared in place, short others are aligned, long others cost their longer side."""
    wa, pa, na = np.unique(a, return_index=True, return_counts=True)
    wb, pb, nb = np.unique(b, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(wa[na == 1], wb[nb == 1], assume_unique=True, return_indices=True)
    pa, pb = pa[na == 1][ia], pb[nb == 1][ib]
    order = np.argsort(pa)
    pa, pb = pa[order], pb[order]
    while len(pb) and (np.diff(pb) < 0).any():  # words that stand out of order are no anchors
        back = np.concatenate(([False], np.diff(pb) < 0)) | np.concatenate((np.diff(pb) < 0, [False]))
        pa, pb = pa[~back], pb[~back]
    pa, pb = np.concatenate(([-1], pa, [len(a)])), np.concatenate(([-1], pb, [len(b)]))
    ga, gb = np.diff(pa) - 1, np.diff(pb) - 1
    gap = np.searchsorted(pa, np.arange(len(a)), "right") - 1
    even = (ga == gb)[gap]
    places = np.flatnonzero(even)
    differ = a[places] != b[places + (pb - pa)[gap[places]]]
    total = int(differ.sum())
    for i in np.flatnonzero(ga != gb).tolist():
        x, y = int(ga[i]), int(gb[i])
        if x and y and max(x, y) <= 48:
            total += edits(a[pa[i] + 1 : pa[i + 1]].tolist(), b[pb[i] + 1 : pb[i + 1]].tolist(), 48)
        else:
            total += max(x, y)
    return total


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether similarity reaches the threshold. The exact band alignment decides wherever bounds don't."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - SIMILAR) + 1e-9)
    if not longer or abs(len(a) - len(b)) > most:
        return False
    counts = [np.bincount((x & np.uint64(4095)).astype(np.int64), minlength=4096) for x in (a, b)]
    if (int(np.abs(counts[0] - counts[1]).sum()) + abs(len(a) - len(b))) // 2 > most:
        return False
    return longer > SHORT and aligned(a, b) <= most or edits(a.tolist(), b.tolist(), most) is not None


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b), distinct, with ``alike``. A hot ``a`` may be split over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        last, words = None, []
        for batch in batches:
            alike = []
            for i in range(batch.num_rows):
                if (at := batch.column(0)[i].as_py()) != last:
                    last, words = at, known.of(words_of(batch.column(2)[i].as_py()))
                alike.append(similar(words, known.of(words_of(batch.column(3)[i].as_py()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], ["a", "b", "alike"])

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long, alike boolean")


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """texts of saved pairs (a, b), if these are few, so that the others aren't shuffled for them; else all of them."""
    if pairs.count() > FEW:
        return texts
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return saved(texts.join(F.broadcast(ends.distinct()), "node", "left_semi"), "paired")


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle. Spark sizes exploded rows as if they were the rows before, 48 times too low for a node's keys, and numbers that
    files hold well some ten times too low; so it would broadcast memberships, which are many for each node."""
    return df.hint("merge")


def in_buckets(members: DataFrame) -> DataFrame:
    """members (key, node) of buckets with two or more of them, with the bucket's smallest member."""
    sizes = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("centre")).where("_n > 1").drop("_n")
    return members.join(shuffled(sizes), "key")


def lacking(some: np.ndarray, sums: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The larger of what counts by bin (rows, with their sums) and ``own`` lack of each other."""
    apart = np.abs(some - own).sum(1, dtype=np.int64)
    return (apart + np.abs(sums - own.sum(dtype=np.int64))) // 2


def within_bounds(key: int, keys: np.ndarray, code: np.ndarray, n: np.ndarray, bins: np.ndarray, left: np.ndarray, right: np.ndarray | None, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of unlike ``code``, one of ``left`` and one of ``right`` (two of ``left`` without it), that no bound
    excludes, in the bucket ``key`` only if it is the first that both are in: so of all buckets just one has a pair.

    An edit takes out one word at most and brings in one at most, so there are no fewer edits than the larger
    of what two counts of words by bin lack of each other; counts that stop at 255 only bring them nearer.
    ``best``: of each i only the j of the least bound.
    """
    alone = right is None
    left = left[np.argsort(n[left], kind="stable")]
    right = left if alone else right[np.argsort(n[right], kind="stable")]
    coarse = bins.reshape(len(bins), -1, COARSE).sum(1, dtype=np.int16)
    lengths, codes, near = n[right], code[right], coarse[right]
    sums = near.sum(1, dtype=np.int64)
    ends = np.searchsorted(lengths, n[left] / SIMILAR + 1, "right")
    starts = np.arange(len(left)) + 1 if alone else np.searchsorted(lengths, n[left] * SIMILAR - 1, "left")
    out_i, out_j = [], []
    for at, (i, start, end) in enumerate(zip(left.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        most = (np.maximum(lengths[start:end], n[i]) * (1 - SIMILAR) + 1e-9).astype(np.int64)
        open_ = np.flatnonzero((codes[start:end] != code[i]) & (np.abs(lengths[start:end] - n[i]) <= most))
        if not len(open_):
            continue
        some = near[start:end] if len(open_) == end - start else near[start + open_]
        open_ = open_[lacking(some, sums[start + open_], coarse[i]) <= most[open_]]
        if len(open_):
            apart = lacking(bins[right[start + open_]].astype(np.int16), sums[start + open_], bins[i].astype(np.int16))
            open_, apart = open_[apart <= most[open_]], apart[apart <= most[open_]]
        if len(open_):
            shared = keys[right[start + open_]] == keys[i]
            first = keys[i][shared.argmax(1)] == key
            open_, apart = open_[first], apart[first]
        if best and len(open_):
            open_ = open_[[apart.argmin()]]
        out_j.append(right[start + open_])
        out_i.append(np.full(len(out_j[-1]), i))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def mixed(members: DataFrame) -> DataFrame:
    """members (key, node, class, ...) of buckets with more than one class, with the bucket's ``size``."""
    several = members.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key", "size")
    return members.join(several, "key")


def with_partners(held: DataFrame, slim: DataFrame) -> DataFrame:
    """held (key, node, class, size) without members of buckets of up to SLICE that lengths and ``slim`` (node, n, slim) keep apart from
    every member of another class there: they are in no pair of within_bounds. Members of larger buckets all stay."""
    names = ["key", "node", "class", "size"]

    def met(rows: pa.Table) -> pa.Table:
        key, code, n = (rows.column(c).to_numpy() for c in ("key", "class", "n"))
        bins = np.frombuffer(b"".join(rows.column("slim").to_pylist()), np.uint8).reshape(-1, SLIM).astype(np.int16)
        sums, found = bins.sum(1, dtype=np.int64), np.zeros(len(key), bool)
        at, step = np.arange(len(key)), 1
        while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):  # every two members of a bucket, by their distance
            i = at[~(found[at] & found[at + step]) & (code[at] != code[at + step])]
            j = i + step
            most = (np.maximum(n[i], n[j]) * (1 - SIMILAR) + 1e-9).astype(np.int64)
            open_ = np.abs(n[i] - n[j]) <= most
            i, j, most = i[open_], j[open_], most[open_]
            near = (np.abs(bins[i] - bins[j]).sum(1, dtype=np.int64) + np.abs(sums[i] - sums[j])) // 2 <= most
            found[i[near]] = found[j[near]] = True
            step += 1
        return rows.filter(pa.array(found)).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = rows.column("key").to_numpy()
            done = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            yield from met(rows.slice(0, done)).to_batches()
            rest = rows.slice(done)
        if rest is not None:
            yield from met(rest).to_batches()

    few = held.where(F.col("size") <= SLICE).join(shuffled(slim), "node").select(*names, "n", "slim")
    return map_batches(few.repartition("key").sortWithinPartitions("key"), run, "key long, node long, class long, size long").unionByName(held.where(F.col("size") > SLICE).select(*names))


def open_pairs(held: DataFrame, best: bool, facts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, distinct, that share a bucket, are in different classes and not excluded by within_bounds.

    ``held`` (key, node, class, size) names the members of buckets; ``facts`` has (node, n, keys, bins) once for each of these nodes, or else ``held`` has.
    Each pair comes once. A bucket of up to SLICE members is a group of rows. A larger one is written in slices of about SLICE members,
    each row once, and every two slices are a row of three numbers: the task that gets it reads both. So a bucket of any size
    is compared whole, by many tasks, and no member is copied for it.
    """
    shape = "a long, b long"
    few, many = held.where(F.col("size") <= SLICE), held.where(F.col("size") > SLICE)
    full = lambda rows: rows if facts is None else rows.join(facts, "node")

    def found(rows: pa.Table, key: int, own: np.ndarray, low: int, high: int) -> pa.RecordBatch:
        node, code, n = (rows.column(c).to_numpy() for c in ("node", "class", "n"))
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
        i, j = within_bounds(key, keys, code, n.astype(np.int64), bins, np.flatnonzero(own == low), None if low == high else np.flatnonzero(own == high), best)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows)
            return found(whole, last, np.zeros(len(whole), np.int64), 0, 0)

        last, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (now := int(keys[a])) != last and rows:
                    yield out()
                    rows = []
                last = now
                rows.append(batch.slice(a, b - a))
        if rows:
            yield out()

    columns = ["key", "node", "class", "n", "bins", "keys"]
    pairs = map_batches(full(few).select(*columns).repartition("key").sortWithinPartitions("key"), grouped, shape)
    sizes = many.groupBy("key").agg(F.ceil(F.first("size") / SLICE).cast("int").alias("slices"))
    each = saved(sizes.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("high", F.explode(F.sequence(F.col("low"), F.col("slices") - 1))).select("key", "low", "high"), "slice-pairs")
    if not (n_pairs := each.count()):
        return pairs
    root = shared_folder(held.sparkSession, "slices")
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SLICE)).cast("int")
    sliced = full(many).select(*columns[1:], own.alias("own"), F.col("key").alias("bucket"))
    sliced.repartition("bucket", "own").sortWithinPartitions("bucket", "own").write.partitionBy("bucket", "own").option("compression", "zstd").parquet(root)

    def sliced_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)

        def part(key: int, own: int) -> pa.Table | None:
            listed = fs.get_file_info(pafs.FileSelector(f"{folder}/bucket={key}/own={own}", allow_not_found=True))
            names = [f.path for f in listed if f.base_name.endswith(".parquet") and f.base_name[0] not in "._"]
            return pa.concat_tables([pq.ParquetFile(fs.open_input_file(name)).read() for name in names]) if names else None

        at, first = None, None
        for batch in batches:
            for key, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, low) != at:
                    at, first = (key, low), part(key, low)
                second = None if low == high else part(key, high)
                if first is None or low != high and second is None:
                    continue
                rows = first if second is None else pa.concat_tables([first, second])
                yield found(rows, key, np.repeat([low, high], [len(first), len(rows) - len(first)]), low, high)

    # So small rows would be put into one task, but each is the work of a slice by a slice.
    return pairs.unionByName(map_batches(each.repartition(min(n_pairs, MOST_TASKS), "key", "low", "high"), sliced_pairs, shape))


def classes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) as of components(), over all links between nodes (node, _id, mark, n, slim, keys) that share a bucket."""
    members = saved(in_buckets(nodes.select("node", F.explode("keys").alias("key"))), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "_id", "mark")
    # A node has one id and mark, so its text stays where the join has brought it.
    texts = saved(docs.selectExpr(*IDS, "text").join(wanted, ["_id", "mark"]).groupBy("_id", "mark", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts")
    # Of the centres of a node's buckets, the one that it meets most often: one pair a node, and most of a large class is settled.
    nearest = members.where("node <> centre").groupBy(F.col("node").alias("b")).agg(F.mode("centre", True).alias("a"))
    tested = saved(verified(nearest.select("a", "b"), texts), "nearest")
    roots = rooted(tested.where("alike").select(F.col("b").alias("node"), F.col("a").alias("root")))
    named = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"))
    # Slim rows tell which buckets have more than one class; only their members get counts and keys.
    held = saved(mixed(members.select("key", "node").join(shuffled(named), "node")), "open")
    held = saved(with_partners(held, nodes.select("node", "n", "slim")), "partners")
    # Counts are made of texts that have a partner alone, and held once a text, not once for each of its buckets.
    asked = saved(held.select("node").distinct(), "asked")
    facts = saved(nodes.select("node", "n", "keys").join(asked, "node", "left_semi").join(counted(texts.join(asked, "node", "left_semi")), "node"), "facts")
    for best in (True, False):  # the nearest of each member first, as it joins classes; then all that is left
        pairs = saved(open_pairs(held, best, facts).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        more = saved(verified(pairs, texts_of(pairs, texts)), "more")
        found = more.where("alike").select("a", "b")
        if found.isEmpty():
            if best:
                tested = tested.unionByName(more)
            continue
        # Links between classes, by the classes' names; what they join is renamed.
        name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        links = found.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        new = components(links)
        renamed = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
        roots = saved(renamed.unionByName(new.join(roots.select("node"), "node", "left_anti")), "roots")
        if best:
            tested = tested.unionByName(more)
            now = new.select(F.col("node").alias("class"), F.col("root").alias("_new"))
            # A node is renamed once, not once for each of its buckets.
            named = held.select("node", "class").distinct().join(now, "class", "left").select("node", F.coalesce("_new", "class").alias("class"))
            held = saved(mixed(held.select("key", "node").join(shuffled(named), "node")), "open")
    return roots


def rooted(forest: DataFrame) -> DataFrame:
    """(node, root) from (node, root) with a smaller node for each that may have one itself: every step doubles the way up."""
    now = saved(forest, "forest")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("_above"))
        now = saved(now.join(up, "root", "left").select("node", F.coalesce("_above", "root").alias("root"), F.col("_above").isNotNull().alias("_moved")), "forest")
        if now.where("_moved").isEmpty():
            return now.select("node", "root")
        now = now.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes of edges (a, b) that are not roots. A step leaves no more edges than
    there were, and up to FEW of them are one task's work, as a shuffle would take longer; more are dealt out."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    few = now.count() <= FEW
    dealt = lambda df: df.coalesce(1) if few else df
    mark = None
    while True:
        both = dealt(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = saved(dealt(small).distinct(), "stars")
        seen = dealt(now).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if seen == mark and seen[0] == seen[2] or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): a row each with ``_id`` (never null), ``mark`` of its text, ``digest`` of its words, ``class``, a number
    of its class, and ``class_id`` (never null), its smallest id: of those that no other class has, or else of all; NULL_ID comes last."""
    rows = saved(sketched(docs), "sketches")
    least = F.min(F.struct("_id", "mark")).alias("least")
    nodes = rows.groupBy("digest").agg(least, *(F.first(c).alias(c) for c in ("n", "slim", "keys")))
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least.*", "n", "slim", "keys"), "nodes")
    named = nodes.join(classes(docs, nodes), "node", "left").select("digest", F.coalesce("root", "node").alias("class"))
    rows = saved(rows.select("_id", "mark", "digest").join(named, "digest"), "classes")
    known = rows.where(F.col("_id") != NULL_ID)
    shared = known.groupBy("_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("_id", F.lit(True).alias("shared"))
    first = known.join(shared, "_id", "left").groupBy("class").agg(F.min(F.struct(F.coalesce("shared", F.lit(False)).alias("shared"), "_id"))["_id"].alias("class_id"))
    return rows.join(first, "class", "left").withColumn("class_id", F.coalesce("class_id", F.lit(NULL_ID)))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bare = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(bare("_id").alias("doc_id"), bare("class_id").alias("class_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row, that of the smallest doc_id (nulls last), then of the least digest; of rows
    that repeat id and text the one whose other columns are the least as JSON. Rows stay or go by their text, not by id alone."""
    order = F.struct((F.col("_id") == NULL_ID).alias("last"), "_id", "digest", "mark")
    kept = near_duplicates(docs.select("doc_id", "text")).groupBy("class").agg(F.min(order).alias("k")).select(F.col("k._id").alias("id"), F.col("k.mark").alias("mark"))
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), *(F.expr(x.rsplit(" AS ", 1)[0]).alias(name) for x, name in zip(IDS, ("id", "mark"), strict=True)))
    others = [F.col("row")[c].alias(c) for c in names if c != "text"]
    least = F.min_by("row", F.to_json(F.struct(*others))) if others else F.first("row")
    first = rows.join(kept, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(least.alias("row"))
    return first.select(*(F.col("row")[c].alias(c) for c in names))
