"""Similarity search of many queries at once, scoped, ranked and shaped."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semindex.functions import columns as C
from semindex.functions import constants as K
from semindex.operators.filters import complete_payload
from semindex.sources.shared import saved

#: Rows and bytes of a block of queries at most; bytes of points that meet a block at once; of blocks that a worker keeps; pairs scored at once.
QUERY_BLOCK, BLOCK_BYTES, CHUNK_BYTES, CACHE_BYTES, TILE = 2048, 8 << 20, 32 << 20, 64 << 20, 1 << 20


def profiles(df: DataFrame) -> DataFrame:
    """df (provider, model, dimension, min_score; the latter two may be null) resolved: own value, profile, default."""
    known = df.sparkSession.createDataFrame(list(K.MODEL_PROFILES), "provider string, model string, _dim int, _min double, query_prefix string")
    out = df.join(F.broadcast(known), ["provider", "model"], "left")
    return out.withColumns({"dimension": F.coalesce("dimension", "_dim"), "min_score": F.coalesce("min_score", "_min", F.lit(K.MIN_SCORE))}).drop("_dim", "_min")


@dataclass(frozen=True)
class Block:
    """Some queries as a matrix."""

    ids: np.ndarray
    limits: list[int]
    matrix: np.ndarray
    norms: np.ndarray
    scopes: dict[tuple, list[int]]  # queries by what they look at: a collection or all, a path prefix or all
    asks: np.ndarray | None  # queries x lists: whether each looks into a list of points


#: Blocks that a worker keeps, by file, and their bytes.
_held: OrderedDict[str, list[Block]] = OrderedDict()


def blocks(files: list[str]) -> Iterator[Block]:
    """The blocks of the queries' table, one after the other; a worker keeps those read last, up to CACHE_BYTES of them."""
    for uri in files:
        if uri not in _held:
            _held[uri] = list(read_blocks(uri))
            while len(_held) > 1 and sum(b.matrix.nbytes for bs in _held.values() for b in bs) > CACHE_BYTES:
                _held.popitem(last=False)
        yield from _held[uri]


def read_blocks(uri: str) -> Iterator[Block]:
    """The queries of a file, by the dimension of their vectors: usually one block."""
    fs, name = pafs.FileSystem.from_uri(uri)
    every = pq.read_table(name, filesystem=fs)
    sizes = pc.list_value_length(every.column("vector")).to_numpy()
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = every.filter(pa.array(sizes == dim)).to_pydict()
        matrix = np.array(rows["vector"], np.float64)
        norms = np.sqrt((matrix * matrix).sum(1))
        scopes: dict[tuple, list[int]] = {}
        for i, (place, prefix) in enumerate(zip(rows["collection_id"], rows["prefix"], strict=True)):
            if norms[i] > 0:
                scopes.setdefault((place, None if prefix is None else tuple(prefix)), []).append(i)
        asks = None
        if "probes" in rows:
            asks = np.zeros((len(matrix), 1 + max((max(x) for x in rows["probes"] if x), default=0)), bool)
            for mine, x in zip(asks, rows["probes"], strict=True):
                mine[x] = True
        yield Block(np.array(rows["query_id"]), rows["k"], matrix, norms, scopes, asks)


def tiles(rows: list[int], width: int) -> Iterator[list[int]]:
    """Queries in groups that make TILE pairs with so many points, or one query at a time."""
    step = max(1, TILE // max(width, 1))
    return (rows[i : i + step] for i in range(0, len(rows), step))


def best_of(scores: np.ndarray, at: np.ndarray, k: int, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of points ``at`` with ``scores`` the k best, as the ranking has them: of equal scores those of the least ids."""
    if len(at) > k:
        least = np.partition(scores, -k)[-k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        if len(equal) > k - len(above):
            names = ids.take(pa.array(at[equal])).to_pylist()
            equal = equal[sorted(range(len(equal)), key=names.__getitem__)[: k - len(above)]]
        kept = np.concatenate([above, equal])
        scores, at = scores[kept], at[kept]
    return scores, at


def best_rows(rows: np.ndarray, at: np.ndarray, scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Places of each query's best, ties at the border included."""
    order = np.lexsort((-scores, rows))
    own, ordered = rows[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.minimum(first + limits[own[first]], np.append(first[1:], len(own))) - 1
    counts = np.diff(np.append(first, len(own)))
    return order[ordered >= np.repeat(ordered[last], counts)]


def query_blocks(queries: DataFrame, k: int) -> DataFrame:
    """The queries as a table of files of BLOCK_BYTES of vectors and QUERY_BLOCK rows at most, about."""
    limit = F.least(F.greatest(F.coalesce("max_results", F.lit(k)), F.lit(1)), F.lit(K.MAX_TOP_K))
    asked = queries.select(
        F.col("query_id").cast("long"), "collection_id", C.normalize_prefix("path_prefix").alias("prefix"), limit.cast("int").alias("k"),
        F.col("vector").cast("array<double>").alias("vector"), *(["probes"] if "probes" in queries.columns else []),
    ).where("vector IS NOT NULL")
    n, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    rows = max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * (dim or 1))))
    return saved(asked.repartition(max(1, -(-n // rows))), "queries")


def scored(points: DataFrame, asked: DataFrame, min_score: float) -> DataFrame:
    """(query_id, k, point_id, score): of each CHUNK_BYTES of points the best of each query. A task holds the scores of TILE pairs at once.

    ``asked`` is a table as of query_blocks(); tasks read its files one after the other, so neither the driver nor a plan holds
    queries. A query meets the points of its own dimension, whatever others there are (left_out() counts those that
    none meets). Points with a column ``list_id`` meet only queries that probe their list.
    """
    files, by_list = asked.inputFiles(), "list_id" in points.columns
    slim = points.select("collection_id", "point_id", C.path_segments("file_path").alias("segments"), F.col("vector").cast("array<double>").alias("vector"), *(["list_id"] if by_list else []))

    def best(b: Block, rows: list[int], at: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, ids: pa.Array, out: tuple) -> None:
        held, long = (vectors, lengths) if len(at) == len(vectors) else (vectors[at], lengths[at])
        for some in tiles(rows, len(at)):
            scores = np.round(b.matrix[some] @ held.T / (b.norms[some][:, None] * long), 6)
            for row, line in zip(some, scores, strict=True):
                good = np.flatnonzero(line >= min_score)
                score, good = best_of(line[good], at[good], b.limits[row], ids)
                out[0].append(np.full(len(good), row))
                out[1].append(good)
                out[2].append(score)

    def met(part: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
        vectors = part.column(3).flatten().to_numpy().reshape(part.num_rows, -1)
        lengths = np.sqrt((vectors * vectors).sum(1))
        ids, places, paths = part.column(1), np.array(part.column(0).to_pylist(), object), None
        own = part.column(4).to_numpy() if by_list else None
        for b in blocks(files):
            if b.matrix.shape[1] != dim:
                continue
            out: tuple[list, list, list] = ([], [], [])
            for (place, prefix), rows in b.scopes.items():
                there = lengths > 0
                if place is not None:
                    there &= places == place
                if prefix is not None:
                    paths = part.column(2).to_pylist() if paths is None else paths
                    there &= np.array([tuple(s[: len(prefix)]) == prefix for s in paths])
                at = np.flatnonzero(there)
                if own is None:
                    best(b, rows, at, vectors, lengths, ids, out)
                    continue
                for x in np.unique(own[at]).tolist():
                    if x < b.asks.shape[1] and (asking := [row for row in rows if b.asks[row, x]]):
                        best(b, asking, at[own[at] == x], vectors, lengths, ids, out)
            if out[0]:
                row, at, score = (np.concatenate(x) for x in out)
                limits = np.array(b.limits, np.int32)
                if by_list and len(row):  # the best of each list make the best of all
                    row, at, score = (x[kept] for kept in [best_rows(row, at, score, limits)] for x in (row, at, score))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[row]), pa.array(limits[row]), ids.take(pa.array(at)), pa.array(score)], ["query_id", "k", "point_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sizes = pc.fill_null(pc.list_value_length(part.column(3)), 0).to_numpy()
            for dim in np.unique(sizes[sizes > 0]).tolist():
                yield from met(part if (sizes == dim).all() else part.filter(pa.array(sizes == dim)), dim)

    return slim.mapInArrow(run, "query_id long, k int, point_id string, score double")


def left_out(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(dim, n_points): vectors of dimensions that no query has, and so are compared with none; null for points without a vector."""
    dim = F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim")
    asked = queries.where("vector IS NOT NULL").select(dim).distinct()
    return points.groupBy(dim).agg(F.count("*").alias("n_points")).join(asked, "dim", "left_anti")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to CHUNK_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0  # gone before the chunk is worked on
            yield from whole
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ranked(found: DataFrame) -> DataFrame:
    """The best k of each query's hits, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= K.MAX_TOP_K).where("rank <= k").drop("k")


def topk_search(points: DataFrame, queries: DataFrame, k: int = K.TOP_K, min_score: float = K.MIN_SCORE) -> DataFrame:
    """(query_id, point_id, score, rank): the best points of each query at or above the floor.

    points (collection_id, point_id, file_path, vector), queries (query_id, collection_id or null for all,
    path_prefix, max_results, vector). Queries are written as blocks, which tasks multiply with their points;
    only (query, k, point, score) is shuffled. Scores have 6 decimals, ties are ordered by point_id; vectors of no
    length match nothing.
    """
    return ranked(scored(points, query_blocks(queries, k), min_score))


def weight(path: Column | str, query: Column | str) -> Column:
    """Documents weigh more for a question about documentation, code otherwise."""
    doc = C.is_documentation_path(path)
    docs, code = K.DOC_WEIGHTS["docs"], K.DOC_WEIGHTS["code"]
    return F.when(C.is_docs_query(query), F.when(doc, docs[0]).otherwise(docs[1])).otherwise(F.when(doc, code[0]).otherwise(code[1]))


def rerank(results: DataFrame) -> DataFrame:
    """results (query_id, query, file_path, score, rank, ...) with weighted_score and final_rank; the score stays raw.
    Scores of 6 decimals are weighed by hundredths as integers, so equal products tie and none rests on a rounding."""
    millionths, hundredths = F.round(F.col("score") * 1e6).cast("long"), F.round(weight("file_path", "query") * 100).cast("long")
    out = results.withColumn("weighted_score", millionths * hundredths / 1e8)
    order = Window.partitionBy("query_id").orderBy(F.desc("weighted_score"), F.desc("score"), "rank")
    return out.withColumn("final_rank", F.row_number().over(order))


def search(points: DataFrame, queries: DataFrame, k: int = K.TOP_K, min_score: float = K.MIN_SCORE) -> DataFrame:
    """Top-k, then the winners' rows are fetched (their text never takes part in the ranking), then the re-rank.
    ``points`` is read twice, vectors and ids, then ids and texts: give a stored table, not one that embeds when read."""
    hits = topk_search(points, queries, k, min_score)
    rows = points.select("point_id", "file_path", "start_line", "end_line", "content")
    full = hits.join(rows, "point_id").join(queries.select("query_id", "query"), "query_id")
    return rerank(complete_payload(full))


def response_json(results: DataFrame) -> DataFrame:
    """(query_id, response): the results of a query as one JSON document; at most MAX_TOP_K of them."""
    item = F.struct(F.col("final_rank").alias("rank"), "file_path", "score", "start_line", "end_line", C.trimmed("content").alias("code_chunk"))
    shaped = results.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(item)).alias("results"))
    return shaped.select("query_id", F.to_json(F.struct("query", "results")).alias("response"))


def nearest_lists(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n centroids of greatest cosine of each vector, best first."""
    near = vectors @ centroids.T
    if n == 1:
        return near.argmax(1)[:, None]
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def fitted_lists(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of ``lists`` groups of unit vectors, by k-means on the sphere."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """How many lists hold so much of the k nearest, measured on the sample against all of it."""
    own = nearest_lists(sample, centroids, 1)[:, 0]
    queries = sample[:: max(1, len(sample) // asked)]
    order = nearest_lists(queries, centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], 1)
    top = np.argsort(-(queries @ sample.T), axis=1)[:, : min(k, len(sample))]
    ranks = np.sort(np.take_along_axis(place, own[top], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1
