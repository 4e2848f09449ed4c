"""A stored index of vectors: inverted lists with product quantisation, for approximate and for exact search.

Points are laid out by the list of their nearest centroid, a folder for each list, so a search reads the files of the lists
that some query looks into. With a list go its centroid, its radius (the greatest angle of a member to it) and its size; with a
point, a code of one byte for each CODE_DIMS dimensions of its difference from the centroid, and how far the code is off.

* exact(): the first lists of a query give it a k-th best score; of all others only those are read whose best possible score,
  the cosine of the angle to the centroid less the radius, reaches it. The result is that of the full scan.
* approximate(): in the nearest lists, what codes stand for is scored; the best k of these are scored by their vectors, and so is
  what may reach the k-th of them, given how far codes are off. All of it happens in the task that reads a list. How many lists, and how much is allowed
  for codes, is measured on the sample for the wanted recall, so vectors without groups cost more instead of being missed.

Centroids and code words are fitted on SAMPLE points at most; every point is in the index. Vectors of no length, or of another
dimension than most of the sample, match nothing and are counted as left out. A large list has several files.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semindex.functions import constants as K
from semindex.operators import search as S
from semindex.sources.commits import Files
from semindex.sources.shared import saved

#: Points that an index is fitted on; lists at most; dimensions of a code word and words of a book; rows of a file; lists that a query starts with.
SAMPLE, MOST_LISTS, CODE_DIMS, WORDS, FILE_ROWS, FIRST_LISTS = 20_000, 1024, 8, 256, 500_000, 2
POINTS = "collection_id string, point_id string, file_path string, vector array<double>, list_id int, angle double, code binary, off double"
#: Scores have 6 decimals, bounds may be off by rounding.
MARGIN = 2e-6


def books_of(rest: np.ndarray, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Code words (parts x WORDS x CODE_DIMS) for differences from centroids, by k-means in each part; the last part is filled up with zeros."""
    rng = np.random.default_rng(seed)
    parts = in_parts(rest)
    out = []
    for m in range(parts.shape[1]):
        x = parts[:, m]
        words = x[rng.choice(len(x), WORDS, replace=len(x) < WORDS)].copy()
        for _ in range(rounds):
            own = nearest_words(x, words)
            n = np.bincount(own, minlength=WORDS)
            sums = np.zeros_like(words)
            np.add.at(sums, own, x)
            words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        out.append(words)
    return np.array(out)


def in_parts(x: np.ndarray) -> np.ndarray:
    short = -x.shape[1] % CODE_DIMS
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, CODE_DIMS)


def nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(1)[None] - 2 * x @ words.T).argmin(1)


def encoded(rest: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of differences, and the length of what they leave over."""
    parts = in_parts(rest)
    codes = np.stack([nearest_words(parts[:, m], books[m]) for m in range(len(books))], axis=1).astype(np.uint8)
    back = books[np.arange(len(books)), codes]
    return codes, np.sqrt(((parts - back) ** 2).sum((1, 2)))


def code_scores(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Products of unit queries with what codes stand for (queries x points)."""
    tables = np.einsum("qmd,mwd->mqw", in_parts(queries), books)
    return sum(tables[m][:, codes[:, m]] for m in range(len(books)))


@dataclass(frozen=True)
class VectorIndex:
    folder: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    books: np.ndarray
    probes: int
    allowed: float  # of how far a code is off, what its score may be wrong by
    left_out: int

    @property
    def n_points(self) -> int:
        return int(self.sizes.sum())

    def points(self, spark: SparkSession, lists: list[int] | None = None) -> DataFrame:
        """Points of these lists: the filter is one on folders, so no file of another list is read."""
        stored = spark.read.schema(POINTS).parquet(f"{self.folder}/points")
        return stored if lists is None else stored.where(F.col("list_id").isin([int(x) for x in lists]))

    # -- queries

    def probing(self, queries: DataFrame, probes: np.ndarray | int | None, floor: str | None = None, but_first: int = 0) -> DataFrame:
        """queries with the lists each looks into: the nearest ``probes`` ones; or, with a column ``floor``, all but the first
        ``but_first`` whose best possible score reaches it."""
        centroids, radii = self.centroids, self.radii
        at, low = queries.columns.index("vector"), queries.columns.index(floor) if floor else None
        names = [*queries.columns, "probes"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                floors = batch.column(low).to_pylist() if low is not None else [None] * batch.num_rows
                lists = []
                for v, least in zip(batch.column(at).to_pylist(), floors, strict=True):
                    v = np.array(v if v is not None else [], np.float64)
                    length = np.sqrt(v @ v)
                    if len(v) != centroids.shape[1] or not length:
                        lists.append(None)
                        continue
                    near = centroids @ (v / length)
                    order = np.argsort(-near, kind="stable")
                    if least is None:
                        lists.append(order[:probes].tolist())
                        continue
                    best = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radii))
                    lists.append([int(x) for x in order[but_first:] if best[x] >= least - MARGIN])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names)

        schema = T.StructType([*queries.schema.fields, T.StructField("probes", T.ArrayType(T.LongType()))])
        return queries.mapInArrow(run, schema).where("probes IS NOT NULL")

    def scored(self, asked: DataFrame, k: int, min_score: float) -> DataFrame:
        """Hits of a saved table of queries with probes."""
        lists = [r[0] for r in asked.select(F.explode("probes")).distinct().collect()]  # MOST_LISTS at most
        return S.scored(self.points(asked.sparkSession, lists), S.query_blocks(asked, k), min_score)

    def pairs(self, asked: DataFrame) -> int:
        """Pairs of a query and a point that tables of queries with probes look at."""
        sizes = asked.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.sizes)], "probe long, n long")
        return asked.select(F.explode("probes").alias("probe")).join(sizes, "probe").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def exact(self, queries: DataFrame, k: int = K.TOP_K, min_score: float = K.MIN_SCORE) -> Found:
        """topk_search() by bounds."""
        first = saved(self.probing(queries, FIRST_LISTS), "first")
        some = saved(self.scored(first, k, min_score), "some")
        kth = S.ranked(some).withColumn("_k", F.least(F.greatest(F.lit(1), F.lit(k)), F.lit(K.MAX_TOP_K)))
        limit = F.least(F.greatest(F.coalesce("max_results", F.lit(k)), F.lit(1)), F.lit(K.MAX_TOP_K))
        full = kth.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_kth"))
        floors = first.drop("probes").join(full, "query_id", "left").withColumn("_floor", F.when(F.col("_n") >= limit, F.greatest("_kth", F.lit(float(min_score)))).otherwise(F.lit(float(min_score)))).drop("_n", "_kth")
        rest = saved(self.probing(floors, None, "_floor", FIRST_LISTS).drop("_floor"), "rest")
        hits = S.ranked(some.unionByName(self.scored(rest, k, min_score)))
        return Found(hits, self.pairs(first) + self.pairs(rest), first.count() * self.n_points)

    def approximate(self, queries: DataFrame, k: int = K.TOP_K, min_score: float = K.MIN_SCORE) -> Found:
        asked = saved(self.probing(queries, self.probes), "asked")
        lists = [r[0] for r in asked.select(F.explode("probes")).distinct().collect()]  # MOST_LISTS at most
        found = saved(self.near(self.points(asked.sparkSession, lists), S.query_blocks(asked, k), min_score), "near")
        compared = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return Found(S.ranked(found.where("query_id IS NOT NULL").drop("n")), compared, asked.count() * self.n_points)

    def near(self, points: DataFrame, asked: DataFrame, min_score: float) -> DataFrame:
        """(query_id, k, point_id, score, n): of each chunk of points the best of each query; rows without a query say how many vectors were looked at.

        The k best by codes are scored by their vectors, which gives a query a k-th best score, kept from chunk to chunk; what
        its code says may reach it is scored too, and nothing else.
        """
        files, centroids, books, allowed = asked.inputFiles(), self.centroids, self.books, self.allowed
        slim = points.select("collection_id", "point_id", S.C.path_segments("file_path").alias("segments"), "list_id", "code", "off", "vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floors: dict[int, np.ndarray] = {}  # of each block, the k-th best scores of its queries so far
            for part in S.chunks(batches):
                part = part.take(pa.array(np.argsort(part.column(3).to_numpy(), kind="stable")))
                own, ids = part.column(3).to_numpy(), part.column(1)
                codes = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                meant = books[np.arange(len(books)), codes].reshape(part.num_rows, -1)[:, : centroids.shape[1]] + centroids[own]  # what codes stand for
                slack, places, paths = allowed * part.column(5).to_numpy() + MARGIN, np.array(part.column(0).to_pylist(), object), None
                vectors = part.column(6).flatten().to_numpy().reshape(part.num_rows, -1)
                lengths = np.sqrt((vectors * vectors).sum(1))
                for no, b in enumerate(S.blocks(files)):
                    if b.matrix.shape[1] != centroids.shape[1]:
                        continue
                    kth = floors.setdefault(no, np.full(len(b.matrix), float(min_score)))
                    unit = b.matrix / np.where(b.norms > 0, b.norms, 1)[:, None]
                    out: list[tuple] = []
                    looked = 0
                    for (place, prefix), rows in b.scopes.items():
                        there = own < b.asks.shape[1]
                        if place is not None:
                            there &= places == place
                        if prefix is not None:
                            paths = part.column(2).to_pylist() if paths is None else paths
                            there &= np.array([tuple(s[: len(prefix)]) == prefix for s in paths])
                        at = np.flatnonzero(there)
                        for some in S.tiles(rows, len(at)):
                            asks = b.asks[some]
                            mine = at[asks.any(0)[own[at]]]  # in lists that any of these looks into
                            lines = unit[some] @ meant[mine].T
                            lines[~asks[:, own[mine]]] = -np.inf
                            for row, line in zip(some, lines, strict=True):
                                score = lambda x, row=row: np.round(vectors[x] @ b.matrix[row] / (lengths[x] * b.norms[row]), 6)
                                high = line + slack[mine]
                                maybe, limit = np.flatnonzero(high >= kth[row]), b.limits[row]
                                if len(maybe) > limit:
                                    first = maybe[np.argpartition(line[maybe], -limit)[-limit:]]
                                    kth[row] = max(kth[row], score(mine[first]).min())
                                    maybe = maybe[high[maybe] >= kth[row]]
                                looked += len(maybe)
                                scores = score(mine[maybe])
                                good = scores >= min_score
                                scores, found = S.best_of(scores[good], mine[maybe[good]], limit, ids)
                                out.append((np.full(len(found), row), found, scores))
                                if len(found) == limit:
                                    kth[row] = max(kth[row], scores.min())
                    if out:
                        row, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                        limits, n = np.array(b.limits, np.int32), len(row)
                        told = [(b.ids[row], pa.int64()), (limits[row], pa.int32()), (ids.take(pa.array(found)), None), (scores, pa.float64())]
                        yield pa.RecordBatch.from_arrays([*(x if t is None else pa.array(x, t) for x, t in told), pa.nulls(n, pa.int64())], names)
                        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.string(), pa.float64())), pa.array([looked], pa.int64())], names)

        names = ["query_id", "k", "point_id", "score", "n"]
        return slim.mapInArrow(run, "query_id long, k int, point_id string, score double, n long")


@dataclass(frozen=True)
class Found:
    """Hits as of topk_search(); how many pairs of a query and a vector were compared, and how many there are."""

    hits: DataFrame
    compared: int
    all_pairs: int


def allowance(sample: np.ndarray, centroids: np.ndarray, books: np.ndarray, k: int, recall: float, asked: int = 256) -> float:
    """What share of a code's error has to be allowed for, so that so many of a query's nearest points are within it."""
    own = S.nearest_lists(sample, centroids, 1)[:, 0]
    codes, off = encoded(sample - centroids[own], books)
    queries = sample[:: max(1, len(sample) // asked)]
    true = queries @ sample.T
    top = np.argsort(-true, axis=1)[:, : min(k, len(sample))]
    near = np.stack([code_scores(q[None], codes[t], books)[0] + centroids[own[t]] @ q for q, t in zip(queries, top, strict=True)])
    wrong = np.abs(np.take_along_axis(true, top, 1) - near) / np.maximum(off[top], 1e-12)
    return float(np.quantile(wrong, recall))


def build(points: DataFrame, folder: str, k: int = K.TOP_K, recall: float = 0.97, sample: int = SAMPLE) -> VectorIndex:
    """Builds and stores the index of points (collection_id, point_id, file_path, vector). Only the sample is ever collected."""
    spark = points.sparkSession
    some = points.where("vector IS NOT NULL").select(F.xxhash64("point_id").alias("_h"), F.col("vector").cast("array<double>").alias("vector"))
    rows = [r.vector for r in some.orderBy("_h").limit(sample).collect()]
    dim = Counter(map(len, rows)).most_common(1)[0][0] if rows else 0
    held = np.array([r for r in rows if len(r) == dim], np.float64).reshape(len(rows) and -1, dim)
    norms = np.sqrt((held * held).sum(1))
    held = held[norms > 0] / norms[norms > 0][:, None]
    if not len(held):
        empty = VectorIndex(folder, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, WORDS, CODE_DIMS)), 0, 1.0, points.count())
        spark.createDataFrame([], POINTS).write.partitionBy("list_id").parquet(f"{folder}/points")
        return stored(spark, empty)
    centroids = S.fitted_lists(held, int(min(MOST_LISTS, max(1, points.count() ** 0.5))))
    books = books_of(held - centroids[S.nearest_lists(held, centroids, 1)[:, 0]])
    names = [f.split()[0] for f in POINTS.split(", ")]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [v if v is not None and len(v) == dim else None for v in batch.column(3).to_pylist()]
            fit = np.array([v is not None and any(v) for v in vectors], bool)
            x = np.array([v for v, ok in zip(vectors, fit, strict=True) if ok], np.float64).reshape(-1, dim)
            unit = x / np.sqrt((x * x).sum(1))[:, None]
            own = S.nearest_lists(unit, centroids, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            codes, off = encoded(unit - centroids[own], books)
            angle = np.arccos(np.clip((unit * centroids[own]).sum(1), -1, 1))
            kept = batch.filter(pa.array(fit))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own.astype(np.int32)), pa.array(angle), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names)

    slim = points.select("collection_id", "point_id", "file_path", F.col("vector").cast("array<double>").alias("vector"))
    in_lists = saved(slim.mapInArrow(placed, POINTS), "placed")
    stats = in_lists.groupBy("list_id").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in stats.collect():  # MOST_LISTS at most
        sizes[r.list_id], radii[r.list_id] = r.n, r.radius
    files = spark.createDataFrame([(i, int(-(-n // FILE_ROWS) or 1)) for i, n in enumerate(sizes)], "list_id int, _n int")
    share = F.pmod(F.xxhash64("point_id"), F.col("_n")).alias("_s")
    laid = in_lists.join(F.broadcast(files), "list_id").withColumn("_s", share).repartition("list_id", "_s").drop("_n", "_s")
    laid.write.partitionBy("list_id").option("compression", "zstd").parquet(f"{folder}/points")
    probes = S.probes_needed(held, centroids, k, recall)
    return stored(spark, VectorIndex(folder, centroids, radii + 1e-7, sizes, books, probes, allowance(held, centroids, books, k, recall), points.count() - int(sizes.sum())))


def stored(spark: SparkSession, index: VectorIndex) -> VectorIndex:
    """Writes all but the points: a row for each list and code word, and the numbers."""
    lists = [(i, [float(x) for x in c], float(r), int(n)) for i, (c, r, n) in enumerate(zip(index.centroids, index.radii, index.sizes, strict=True))]
    spark.createDataFrame(lists, "list_id int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{index.folder}/lists")
    words = [(m, w, [float(x) for x in index.books[m, w]]) for m in range(len(index.books)) for w in range(WORDS)]
    spark.createDataFrame(words, "part int, word int, vector array<double>").coalesce(1).write.parquet(f"{index.folder}/books")
    Files(spark, index.folder).create("index.json", json.dumps({"probes": index.probes, "allowed": index.allowed, "left_out": index.left_out}))
    return index


def load(spark: SparkSession, folder: str) -> VectorIndex:
    numbers = json.loads(Files(spark, folder).read("index.json"))
    lists = spark.read.parquet(f"{folder}/lists").orderBy("list_id").collect()
    words = spark.read.parquet(f"{folder}/books").orderBy("part", "word").collect()
    centroids = np.array([r.centroid for r in lists], np.float64) if lists else np.zeros((0, 0))
    books = np.array([r.vector for r in words], np.float64).reshape(-1, WORDS, CODE_DIMS)
    return VectorIndex(folder, centroids, np.array([r.radius for r in lists]), np.array([r.n for r in lists], np.int64), books, **numbers)
