"""Jobs: incremental refresh and full rebuild of an index; search of a query table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semindex.functions import columns as C
from semindex.functions import constants as K
from semindex.operators import chunking, diff, filters
from semindex.operators.embedding import Embedder, embed
from semindex.operators.search import search
from semindex.operators.store import delete_points, mark_run, upsert_points
from semindex.operators.vectors import embed_once
from semindex.sources.commits import Key, Part, State, Store
from semindex.sources.corpus import file_system, list_corpus, with_contents
from semindex.sources.shared import saved


@dataclass(frozen=True)
class Refreshed:
    points: DataFrame
    manifest: DataFrame
    summary: DataFrame


def make_points(
    files: DataFrame, embedder: Embedder, root: Column | None = None, prefix: str | None = None, partitions: int | None = None, vectors: tuple[Store, str] | None = None
) -> DataFrame:
    """Blocks of the files with ids and vectors. Texts are dealt out evenly before they are embedded; vectors are never shuffled. With
    ``vectors``, a store and a model's name, vectors come from there, and only texts that it lacks are embedded (operators/vectors.py)."""
    blocks = chunking.with_ids(filters.non_blank(chunking.chunk_files(files)), root)
    if vectors is not None:
        return embed_once(saved(blocks.drop("piece_offset"), "blocks"), "content", embedder, *vectors, prefix=prefix, partitions=partitions).rows
    blocks = blocks.repartition(partitions, "point_id") if partitions else blocks.repartition("point_id")
    return embed(blocks.drop("piece_offset"), "content", embedder, prefix=prefix)


def refresh_index(
    files: DataFrame, manifest: DataFrame, points: DataFrame, embedder: Embedder, max_bytes: int = K.MAX_FILE_BYTES, adopted: DataFrame | None = None, collections: DataFrame | None = None
) -> Refreshed:
    """Diff, delete, chunk, embed, upsert over tables, as new tables. Points of all re-chunked paths go, so an interrupted run leaves no orphans.

    Fresh points and the diff are written to the shared folder once, and all else is derived from there, so each text is
    embedded once. Rows of collections other than ``collections`` (by default those of ``files``) stay. ``adopted`` names
    collections that have points but no manifest. run_index() keeps a store instead, and writes only what changes.
    """
    files = filters.filter_supported(files)
    change = saved(diff.change_diff(files, manifest, max_bytes, collections), "change")
    todo = change.where(F.col("change").isin("new", "changed")).select(*diff.KEYS)
    fresh = saved(make_points(files.join(todo, diff.KEYS, "left_semi"), embedder), "fresh")
    kept = delete_points(points, diff.delete_set(change, include_new=True))
    counts = fresh.groupBy("collection_id").agg(F.count("*").alias("n_blocks"))
    return Refreshed(upsert_points(kept, fresh), new_manifest(manifest, change), diff.index_summary(change, counts, adopted))


def new_manifest(manifest: DataFrame, change: DataFrame) -> DataFrame:
    rest = manifest.join(change.where("change <> 'unchanged' AND change <> 'skipped'"), diff.KEYS, "left_anti")
    return rest.unionByName(change.where(F.col("change").isin("new", "changed")).select(*diff.KEYS, "file_hash"))


MANIFEST = "collection_id string, file_path string, file_hash string"
RUNS = "collection_id string, run_id string, indexing_complete boolean, started_at timestamp, completed_at timestamp, vector_dim int"


def mark(store: Store, state: State, scope: list[str], run_id: str, at: str, complete: bool, dim: int) -> dict[Key, Part | None]:
    """New parts of the table of markers, which has one bucket for each collection."""
    spark = store.spark
    held = store.read_parts("runs", state.of("runs", scope).values(), RUNS)
    ids = spark.createDataFrame([(c,) for c in scope], "collection_id string")
    return dict(store.write_parts(mark_run(held, ids, run_id, at, complete, dim).withColumn("bucket", F.lit(0)), "runs"))


def run_index(
    spark: SparkSession, files: DataFrame, store: str | Store, embedder: Embedder, dim: int, run_id: str, at: str, max_bytes: int = K.MAX_FILE_BYTES, collections: DataFrame | None = None,
    vectors: tuple[Store, str] | None = None,
) -> DataFrame:
    """One durable run over the tables points, manifest and runs of a store (sources/commits.py); returns the summary.

    A run looks at its own ``collections`` only (by default those of ``files``; name one whose files have all gone), and
    of these it rewrites only the buckets that changed, deleted or new paths fall into. Its markers say incomplete before
    anything changes; points, manifest and the complete marker follow in one commit, so a run that stops anywhere has
    changed nothing but the marker. A run raises Conflict if another one has committed to one of its collections meanwhile.
    With ``vectors`` (a store, this one or another, and a model's name) equal texts are embedded once over all runs.
    Collections whose points have another dimension than ``dim`` are rebuilt; those with points and no manifest are adopted:
    all their files are indexed anew under the same ids, and the summary says so. Both are read off the log, not off points.
    """
    store = store if isinstance(store, Store) else Store(spark, store)
    looked_at = saved((files if collections is None else collections).select("collection_id").distinct(), "scope")
    scope = sorted(r[0] for r in looked_at.collect())  # a line for each collection of the run
    if not scope:
        return diff.index_summary(diff.change_diff(files, spark.createDataFrame([], MANIFEST), max_bytes, looked_at), files.groupBy("collection_id").agg(F.count("*").alias("n_blocks")))
    state = store.state()
    state = store.commit(state, mark(store, state, scope, run_id, at, False, dim), schemas={"runs": T.StructType.fromDDL(RUNS).json()})
    points, manifest = state.of("points", scope), state.of("manifest", scope)
    stale = {c for (c, _), p in points.items() if p.dims is not None and p.dims != (dim, dim)}
    adopted = sorted({c for c, _ in points} - {c for c, _ in manifest} - stale)

    known = store.read_parts("manifest", [p for (c, _), p in manifest.items() if c not in stale], MANIFEST)
    files = filters.filter_supported(files)
    change = saved(diff.change_diff(files, known, max_bytes, looked_at), "change")
    sizes = {r.collection_id: r.n for r in change.groupBy("collection_id").agg(F.count("*").alias("n")).collect()}
    buckets = store.bucket_counts(sizes) | {c: n for c, n in state.buckets.items() if c in scope and c not in stale}
    counts = write_changes(store, state, scope, files, change, buckets, stale, embedder, dim, run_id, at, vectors)
    return diff.index_summary(change, counts, spark.createDataFrame([(c,) for c in adopted], "collection_id string"))


def write_changes(
    store: Store, state: State, scope: list[str], files: DataFrame, change: DataFrame, buckets: dict[str, int], stale: set[str], embedder: Embedder, dim: int, run_id: str, at: str,
    vectors: tuple[Store, str] | None = None, more: dict[Key, Part | None] | None = None,
) -> DataFrame:
    """Points and manifest of the buckets that a (saved) change falls into, the complete markers and ``more``, in one commit; returns blocks per collection."""
    points, manifest = state.of("points", scope), state.of("manifest", scope)
    moved = store.with_bucket(change.where("change <> 'unchanged' AND change <> 'skipped'"), buckets)
    touched = {(r.collection_id, r.bucket) for r in moved.select("collection_id", "bucket").distinct().collect()}  # a line for each bucket that changes
    todo = change.where(F.col("change").isin("new", "changed")).select(*diff.KEYS)
    fresh = saved(make_points(files.join(todo, diff.KEYS, "left_semi"), embedder, vectors=vectors), "fresh")

    new: dict[Key, Part | None] = {("points", c, b): None for c, b in points if c in stale or (c, b) in touched}
    new |= {("manifest", c, b): None for c, b in manifest if c in stale or (c, b) in touched}
    if touched:
        old = store.read_parts("points", [p for (c, b), p in points.items() if c not in stale and (c, b) in touched], fresh.schema)
        kept = upsert_points(delete_points(old, diff.delete_set(change, include_new=True)), fresh)
        new |= store.write_parts(store.with_bucket(kept, buckets), "points")
        held = store.read_parts("manifest", [p for (c, b), p in manifest.items() if c not in stale and (c, b) in touched], MANIFEST)
        new |= store.write_parts(store.with_bucket(new_manifest(held, change), buckets), "manifest")
    new |= mark(store, state, scope, run_id, at, True, dim) | (more or {})
    store.commit(state, new, buckets, {"points": fresh.schema.json(), "manifest": T.StructType.fromDDL(MANIFEST).json()})
    return fresh.groupBy("collection_id").agg(F.count("*").alias("n_blocks"))


def apply_changes(
    spark: SparkSession, changes: DataFrame, store: Store, embedder: Embedder, dim: int, run_id: str, at: str, max_bytes: int = K.MAX_FILE_BYTES,
    vectors: tuple[Store, str] | None = None, more: dict[Key, Part | None] | None = None,
) -> DataFrame | None:
    """changes (collection_id, file_path, resolved_path, size_bytes, content; null content: the file is gone): brings a store in step for
    these paths alone, whatever else their collections hold. What is read and written are the buckets of these paths. A run
    id that the store has as complete for all of the collections has been applied before: nothing is done, and None returned."""
    named = saved(changes, "changes")
    looked_at = named.select("collection_id").distinct()
    scope = sorted(r[0] for r in looked_at.collect())
    state = store.state()
    done = store.read_parts("runs", state.of("runs", scope).values(), RUNS).where((F.col("run_id") == run_id) & F.col("indexing_complete"))
    if not scope or done.select("collection_id").distinct().count() == len(scope):
        return None
    state = store.commit(state, mark(store, state, scope, run_id, at, False, dim), schemas={"runs": T.StructType.fromDDL(RUNS).json()})
    sizes = {r.collection_id: r.n for r in named.groupBy("collection_id").agg(F.count("*").alias("n")).collect()}
    buckets = store.bucket_counts(sizes) | {c: n for c, n in state.buckets.items() if c in scope}
    paths = named.select(*diff.KEYS).distinct()
    asked = {(r.collection_id, r.bucket) for r in store.with_bucket(paths, buckets).select("collection_id", "bucket").distinct().collect()}
    known = store.read_parts("manifest", [p for k, p in state.of("manifest", scope).items() if k in asked], MANIFEST).join(paths, diff.KEYS, "left_semi")
    files = filters.filter_supported(named.where("content IS NOT NULL"))
    change = saved(diff.change_diff(files, known, max_bytes, looked_at), "change")
    counts = write_changes(store, state, scope, files, change, buckets, set(), embedder, dim, run_id, at, vectors, more)
    return diff.index_summary(change, counts)


LISTING = "collection_id string, file_path string, size_bytes long, modified timestamp"


def run_tree(
    spark: SparkSession, root: str, store: Store, embedder: Embedder, dim: int, run_id: str, at: str, max_bytes: int = K.MAX_FILE_BYTES, full: bool = False, vectors: tuple[Store, str] | None = None
) -> DataFrame | None:
    """A run over the files below a folder that opens only what its listing says has changed; the summary, None if nothing has.

    The store keeps the listing (path, size, time of change) by bucket, and in its log a digest of each bucket's. Buckets of equal digest
    are not looked at; in the others, files whose line is new are read and hashed. ``full`` reads all files, as a change that
    keeps size and time is not seen otherwise.
    """
    listing = saved(list_corpus(spark, root, max_bytes), "listing")
    name = collection_of(spark, root)
    state = store.state()
    buckets = {name: state.buckets.get(name) or store.bucket_counts({name: listing.count()})[name]}
    keyed = store.with_bucket(listing, buckets)
    line = F.xxhash64("file_path", "size_bytes", "modified")
    digests = {r.bucket: r.d for r in keyed.groupBy("bucket").agg(F.bit_xor(line).alias("d")).collect()}
    old = {b: p for (_, b), p in state.of("listing", [name]).items()}
    differ = sorted(b for b in digests.keys() | old.keys() if full or b not in digests or b not in old or old[b].digest != digests[b])
    if not differ:
        return None
    before = store.read_parts("listing", [old[b] for b in differ if b in old], LISTING)
    now = saved(keyed.where(F.col("bucket").isin(differ)), "now")
    moved = now if full else now.join(before, [*diff.KEYS, "size_bytes", "modified"], "left_anti")
    read = with_contents(moved.select(*diff.KEYS, "resolved_path", "size_bytes").repartition(spark.sparkContext.defaultParallelism), root)
    gone = before.join(now, diff.KEYS, "left_anti").select(*diff.KEYS, F.col("file_path").alias("resolved_path"), "size_bytes", F.lit(None).cast("string").alias("content"))
    parts: dict[Key, Part | None] = {("listing", name, b): None for b in old if b in differ}
    parts |= {k: replace(p, digest=digests[k[2]]) for k, p in store.write_parts(now.select(*diff.KEYS, "size_bytes", "modified", "bucket"), "listing").items()}  # type: ignore[type-var]
    return apply_changes(spark, read.unionByName(gone), store, embedder, dim, run_id, at, max_bytes, vectors, parts)


def collection_of(spark: SparkSession, root: str) -> str:
    return spark.range(1).select(C.collection_id(F.lit(file_system(root)[1]))).first()[0]


def rebuild_index(files: DataFrame, embedder: Embedder, max_bytes: int = K.MAX_FILE_BYTES) -> Refreshed:
    empty_manifest = files.sparkSession.createDataFrame([], MANIFEST)
    points = make_points(files.where(F.lit(False)), embedder)
    return refresh_index(files, empty_manifest, points, embedder, max_bytes)


def search_table(points: DataFrame, queries: DataFrame, embedder: Embedder, k: int = K.TOP_K, min_score: float = K.MIN_SCORE, prefix: str | None = None) -> DataFrame:
    """queries (query_id, query, collection_id, path_prefix, max_results): each embedded once, searched, re-ranked. ``points`` is a stored table."""
    asked = saved(embed(queries, "query", embedder, prefix=prefix).where("vector IS NOT NULL"), "asked")
    return search(points, asked, k, min_score)
