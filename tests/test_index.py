import base64
import os
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semindex.jobs.index import rebuild_index, refresh_index, run_index, search_table
from semindex.jobs.queries import POINTS as QUERIES_POINTS
from semindex.operators import embedding, search, store, vector_index
from semindex.sources import derived as D
from semindex.sources.commits import Conflict, Files, Store


def corpus(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, content string")
    return df.select(F.lit("ws-1").alias("collection_id"), "file_path", F.col("file_path").alias("resolved_path"), F.length("content").cast("long").alias("size_bytes"), "content")


def ids(df):
    return sorted(r.point_id for r in df.select("point_id").collect())


def test_incremental_equals_rebuild(spark):
    e = embedding.hashing_embedder(16)
    text = lambda word: f"{word} words of a file that is long enough to be kept as a block\n" * 3
    first = corpus(spark, [("a.ts", text("one")), ("b.ts", text("two")), ("c.md", "# T\n" + text("three")), ("d.txt", text("no"))])
    one = rebuild_index(first, e)
    points, manifest = one.points.cache(), one.manifest.cache()
    again = refresh_index(first, manifest, points, e)
    assert [r.reason for r in again.summary.collect()] == ["already-fresh"]
    assert ids(again.points) == ids(points)
    second = corpus(spark, [("a.ts", text("one")), ("b.ts", text("changed") * 5), ("e.py", text("new"))])
    two = refresh_index(second, manifest, points, e)
    assert ids(two.points) == ids(rebuild_index(second, e).points)
    row = two.summary.first()
    assert (row.processed_files, row.deleted_files, row.reason) == (2, 1, "incremental-index-applied")
    assert {r.file_path for r in two.manifest.collect()} == {"a.ts", "b.ts", "e.py"}


def test_store(spark):
    points = spark.createDataFrame([("c", "a", "1"), ("c", "a/b", "2"), ("c", "ab", "3")], "collection_id string, file_path string, point_id string")
    gone = spark.createDataFrame([("c", "a")], "collection_id string, file_path string")
    assert ids(store.delete_points(points, gone)) == ["2", "3"]
    assert ids(store.delete_points(points, gone, prefix=True)) == ["3"]
    runs = spark.createDataFrame([], "collection_id string, run_id string, indexing_complete boolean, started_at timestamp, completed_at timestamp, vector_dim int")
    runs = store.mark_run(store.mark_run(runs, points, "r", "2024-01-01", False, 3), points, "r", "2024-01-02", True, 3)
    assert [(r.run_id, r.indexing_complete) for r in runs.collect()] == [("r", True)]


def test_embedding_edges(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        return np.ones((len(texts), 2))

    assert embedding.with_retries(lambda: flaky(["a"]), first_ms=0).shape == (1, 2)
    df = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None), (4, "x" * 40_000)], "i int, t string")
    got = {r.i: r.vector for r in embedding.embed(df, "t", embedding.hashing_embedder(4)).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None and got[4] is None
    wire = spark.createDataFrame([(base64.b64encode(np.array([1.5, -2], "<f4").tobytes()).decode(),), (None,)], "v string")
    assert [r.v for r in embedding.decode_vectors(wire, "v").collect()] == [[1.5, -2.0], None]
    assert embedding.needs_rebuild(spark.createDataFrame([([1.0, 2.0],)], "vector array<float>"), 3)


def test_token_batches(spark):
    items = spark.createDataFrame([("k", 1, 8191), ("k", 2, 8192)] + [("k", i, 8000) for i in range(3, 17)], "batch_key string, seq long, tokens long")
    got = [r.batch_no for r in embedding.token_batches(items).orderBy("seq").collect()]
    assert got[1] is None and got[0] == 0 and got[12] == 0 and got[13] == 1


def fold(rows, most, item_most):
    """The packing as one loop over a key's items."""
    out, key, held, no = [], object(), 0, 0
    for k, seq, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if k != key:
            key, held, no = k, 0, 0
        if n > item_most:
            out.append((k, seq, n, None))
            continue
        if held and held + n > most:
            held, no = 0, no + 1
        held += n
        out.append((k, seq, n, no))
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "item_most"), [(100, 40), (100, 100), (30, 60), (7, 7)])
def test_packing_by_ranges_equals_the_fold(spark, most, item_most):
    rng = np.random.default_rng(most)
    rows = [("hot", i, int(rng.choice([0, 0, 1, 3, 20, 39, 60, 101]))) for i in range(900)] + [(k, i // 2, int(rng.integers(0, 50))) for k in ("a", "b", None, "z") for i in range(40)]
    items = spark.createDataFrame(rows, "batch_key string, seq long, tokens long").repartition(3)
    got = sorted((tuple(r) for r in embedding.token_batches(items, most, item_most, ranges=11).collect()), key=str)
    assert got == fold(rows, most, item_most)


def test_a_hot_key_is_spread_over_all_ranges(spark):
    from semindex.sources.shared import in_ranges

    items = spark.range(20_000).selectExpr("'hot' AS batch_key", "id AS seq", "id % 90 AS tokens")
    sizes = sorted(r["count"] for r in in_ranges(items, "batch_key", "seq", ranges=8).groupBy("part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_search_ties_floor_and_zero_vectors(spark):
    points = spark.createDataFrame([("c", p, f, [float(x) for x in v]) for p, f, v in (("b", "src/x", [1, 0]), ("a", "src/y", [2, 0]), ("z", "x", [0, 0]), ("d", "docs/x", [1, 1]))], "collection_id string, point_id string, file_path string, vector array<float>")
    schema = "query_id long, collection_id string, path_prefix string, max_results int, vector array<float>"
    queries = spark.createDataFrame([(1, None, None, None, [1.0, 0.0]), (2, "c", "src", 1, [1.0, 0.0]), (3, "other", None, None, [1.0, 0.0])], schema)
    got = sorted(tuple(r) for r in search.topk_search(points, queries, min_score=0.7).select("query_id", "rank", "point_id", "score").collect())
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, "d", 0.707107), (2, 1, "a", 1.0)]


def test_no_vector_is_shuffled(spark):
    queries = spark.createDataFrame([(1, None, None, None, [1.0] * 64)], "query_id long, collection_id string, path_prefix string, max_results int, vector array<float>")
    points = spark.createDataFrame([("c", "a", "x", [1.0] * 64)], "collection_id string, point_id string, file_path string, vector array<float>")
    plan = search.topk_search(points, queries)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and not any("vector" in line for line in plan.split("\n") if "Exchange hash" in line)


def test_code_first_and_docs_first(spark):
    rows = [(q, t, p, s, r) for q, t in ((1, "password check"), (2, "read the readme")) for p, s, r in (("README.md", 0.6854055, 1), ("src/auth/password.ts", 0.6740656, 2))]
    out = search.rerank(spark.createDataFrame(rows, "query_id int, query string, file_path string, score double, rank int"))
    first = {r.query_id: (r.file_path, r.score) for r in out.where("final_rank = 1").collect()}
    assert first == {1: ("src/auth/password.ts", 0.6740656), 2: ("README.md", 0.6854055)}


def test_approximate_search_finds_nine_in_ten(spark):
    sf = "/root/testdata/sf0.01"
    from semindex.jobs import queries as Q

    key = lambda df: {(r.query_id, r.point_id) for r in df.collect()}
    exact, near = key(Q.cosine_topk(spark, sf)), key(Q.ann_topk(spark, sf))
    assert len(exact & near) >= 0.9 * len(exact)


def grouped(spark, n=6000, dim=24):
    rng = np.random.default_rng(4)
    groups = rng.standard_normal((120, dim))
    vectors = groups[np.arange(n) % 120] + 0.35 * rng.standard_normal((n, dim))
    rows = [("c" if i % 3 else "d", str(i), "src/x" if i % 2 else "docs/y", [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [("c", "null", "x", None), ("c", "none", "x", [0.0] * dim), ("c", "short", "x", [1.0, 2.0])]
    points = spark.createDataFrame(rows, "collection_id string, point_id string, file_path string, vector array<float>").repartition(3).cache()
    scope = "CASE WHEN int(point_id) % 40 = 0 THEN 'c' END AS collection_id", "CASE WHEN int(point_id) % 60 = 0 THEN 'docs' END AS path_prefix"
    held = points.where("try_cast(point_id AS int) % 20 = 0").selectExpr("bigint(point_id) AS query_id", *scope, "10 AS max_results", "vector")
    odd = spark.createDataFrame([(-1, None, None, 10, None), (-2, None, None, 10, [0.0] * dim), (-3, None, None, 10, [1.0, 2.0])], held.schema)
    return points, held.unionByName(odd)


def test_index_of_grouped_vectors(spark, tmp_path):
    """Built once and loaded: exact search by bounds equals the full scan and skips most pairs; the approximate one reads few vectors."""
    points, queries = grouped(spark)
    whole = search.topk_search(points, queries.where("query_id >= 0"))
    key = lambda df: {(r.query_id, r.point_id, r.score, r.rank) for r in df.collect()}
    want = key(whole)
    assert vector_index.build(points, str(tmp_path / "index"), k=10).left_out == 3
    index = vector_index.load(spark, str(tmp_path / "index"))
    assert index.n_points == 6000 and index.left_out == 3
    exact = index.exact(queries)
    assert key(exact.hits) == want and exact.compared < 0.25 * exact.all_pairs
    near = index.approximate(queries)
    found = key(near.hits)
    assert len({x[:2] for x in want} & {x[:2] for x in found}) >= 0.9 * len(want) and near.compared < 0.05 * near.all_pairs
    assert {x[:3] for x in found if x[:2] in {w[:2] for w in want}} <= {w[:3] for w in want}  # scores are exact
    plan = index.points(spark, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list_id" in plan.split("PartitionFilters", 1)[1].split("]")[0]
    assert {r.list_id for r in index.points(spark, [3, 5]).collect()} == {3, 5}


def test_index_of_nothing_and_of_few(spark, tmp_path):
    points, queries = grouped(spark)
    index = vector_index.build(points.limit(0), str(tmp_path / "none"))
    assert index.exact(queries).hits.count() == 0 and index.approximate(queries).hits.count() == 0
    few = vector_index.build(points.where("point_id IN ('0', '20', '7')"), str(tmp_path / "few"))
    want = search.topk_search(points.where("point_id IN ('0', '20', '7')"), queries, min_score=-1)
    rows = lambda df: sorted((r.query_id, r.point_id, r.score) for r in df.where("query_id >= 0").collect())
    assert rows(few.exact(queries, min_score=-1).hits) == rows(want)


def test_one_odd_vector_hides_no_others(spark):
    points = spark.createDataFrame([("c", f"{i:02}", "x", [1.0, float(i), 0.0, 1.0]) for i in range(50)], "collection_id string, point_id string, file_path string, vector array<double>").coalesce(1)
    odd = spark.createDataFrame([("c", "odd", "x", [1.0] * 5)], points.schema)
    schema = "query_id long, collection_id string, path_prefix string, max_results int, vector array<double>"
    queries = spark.createDataFrame([(1, None, None, 10, [1.0, 3.0, 0.0, 1.0])], schema)
    hits = lambda p, q: sorted((r.query_id, r.point_id) for r in search.topk_search(p, q).collect())
    want = hits(points, queries)
    assert len(want) == 10 and hits(points.unionByName(odd).coalesce(1), queries) == want
    assert [tuple(r) for r in search.left_out(points.unionByName(odd), queries).collect()] == [(5, 1)]
    mixed = queries.unionByName(spark.createDataFrame([(2, None, None, 10, [1.0] * 5)], schema)).coalesce(1)
    assert hits(points.unionByName(odd), mixed) == sorted([*want, (2, "odd")])


def test_queries_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((90, 8))
    points = spark.createDataFrame([("c", f"{i:02}", "x", [float(x) for x in v]) for i, v in enumerate(vectors)] + [("c", "null", "x", None), ("c", "short", "x", [1.0])], "collection_id string, point_id string, file_path string, vector array<double>")
    queries = spark.createDataFrame([(i, None, None, 4, [float(x) for x in v]) for i, v in enumerate(vectors[:20])] + [(99, None, None, 4, None)], "query_id long, collection_id string, path_prefix string, max_results int, vector array<double>")
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    want = {(q, f"{i:02}") for q in range(20) for i in np.argsort(-(unit[q] @ unit.T))[:4].tolist()}
    assert {(r.query_id, r.point_id) for r in search.topk_search(points, queries, min_score=-1).collect()} == want
    none = queries.limit(0)
    assert search.topk_search(points, none).count() == 0
    monkeypatch.setattr(search, "CACHE_BYTES", 1)
    assert {(r.query_id, r.point_id) for r in search.topk_search(points, queries, min_score=-1).collect()} == want


def test_each_text_is_embedded_once(spark, tmp_path):
    """Through a whole run, by what the embedder writes down."""
    folder = str(tmp_path)

    def counting(texts):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts)))
        return np.ones((len(texts), 4), np.float32)

    files = corpus(spark, [(f"f{i}.ts", f"file {i} has words that are long enough to be kept\n" * 3) for i in range(30)])
    done = refresh_index(files, spark.createDataFrame([], "collection_id string, file_path string, file_hash string"), spark.createDataFrame([], QUERIES_POINTS), counting)
    n = done.points.count()
    assert done.summary.first().indexed_blocks == n and done.manifest.count() == 30
    assert sum(int(open(f"{folder}/{x}").read()) for x in os.listdir(folder)) == n


def test_durable_runs(spark, tmp_path):
    store, e = str(tmp_path / "store"), embedding.hashing_embedder(16)
    text = lambda word: f"{word} words of a file that is long enough to be kept as a block\n" * 3
    first = corpus(spark, [("a.ts", text("one")), ("b.ts", text("two"))])
    assert [r.reason for r in run_index(spark, first, store, e, 16, "r1", "2024-01-01").collect()] == ["incremental-index-applied"]
    assert [r.reason for r in run_index(spark, first, store, e, 16, "r2", "2024-01-02").collect()] == ["already-fresh"]
    marks = {r.run_id: r.indexing_complete for r in Store(spark, store).read("runs").collect()}
    assert marks == {"r1": True, "r2": True}
    wide = embedding.hashing_embedder(32)  # another dimension: all is indexed anew
    assert [r.processed_files for r in run_index(spark, first, store, wide, 32, "r3", "2024-01-03").collect()] == [2]
    assert {len(r.vector) for r in Store(spark, store).read("points").collect()} == {32}

    def broken(texts):
        raise RuntimeError("no service")

    second = corpus(spark, [("a.ts", text("one")), ("b.ts", text("changed"))])
    with pytest.raises(Exception, match="no service"):
        run_index(spark, second, store, broken, 32, "r4", "2024-01-04")
    assert {r.run_id: r.indexing_complete for r in Store(spark, store).read("runs").collect()}["r4"] is False
    assert [r.processed_files for r in run_index(spark, second, store, wide, 32, "r5", "2024-01-05").collect()] == [1]
    assert ids(Store(spark, store).read("points")) == ids(rebuild_index(second, wide).points)


def test_adoption(spark, sf_dir):
    from semindex.jobs import queries as Q

    rows = {(r.run_id, r.collection_id): r for r in Q.adopt(spark, sf_dir).collect()}
    held = {c for _, c in rows}
    for c in held:
        known = c < "ws-8"
        assert rows["r1", c].reason == ("incremental-index-applied" if known else "adopted-existing-roo-index-reconciled")
        assert rows["r2", c].reason == "already-fresh" and rows["r2", c].indexing_complete


def test_search_table(spark):
    docs = spark.createDataFrame([("c", str(i), f"src/f{i}.ts", 1, 2, f"alpha beta word{i} " * 4) for i in range(20)], "collection_id string, point_id string, file_path string, start_line int, end_line int, content string")
    points = embedding.embed(docs, "content", embedding.hashing_embedder(64))
    queries = spark.createDataFrame([(1, "alpha beta word7", None, None, 3)], "query_id long, query string, collection_id string, path_prefix string, max_results int")
    out = search_table(points, queries, embedding.hashing_embedder(64))
    assert out.count() == 3 and out.where("final_rank = 1").first().point_id == "7"
    profiled = search.profiles(spark.createDataFrame([("ollama", "nomic-embed-code", None, None), ("x", "y", 5, None)], "provider string, model string, dimension int, min_score double"))
    assert {(r.dimension, r.min_score) for r in profiled.collect()} == {(3584, 0.15), (5, 0.4)}


def test_derived_corpus(spark, sf_dir):
    assert D.corpus_files(spark, sf_dir).select("collection_id").distinct().count() == 4


def test_points_of_other_collections_stay(spark, tmp_path):
    from semindex.sources.corpus import write_points

    rows = lambda *r: spark.createDataFrame(list(r), "collection_id string, point_id string")
    folder = str(tmp_path / "points")
    write_points(rows(("a", "1"), ("a", "2"), ("b", "3")), folder)
    write_points(rows(("a", "4")), folder)
    assert {(r.collection_id, r.point_id) for r in Store(spark, folder).read("points").collect()} == {("a", "4"), ("b", "3")}


def worktrees(spark, n_files, names=("ws-1", "ws-2", "ws-3"), changed=()):
    rows = [(c, f"src/f{i}.ts", f"{c} file {i} {'changed' if (c, i) in changed else 'first'} words that are long enough to be kept\n" * 2) for c in names for i in range(n_files)]
    df = spark.createDataFrame(rows, "collection_id string, file_path string, content string")
    return df.select("collection_id", "file_path", F.col("file_path").alias("resolved_path"), F.length("content").cast("long").alias("size_bytes"), "content")


def bytes_of(root):
    return {os.path.join(d, f): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_run_over_one_worktree_leaves_the_others(spark, tmp_path):
    root, e = str(tmp_path / "store"), embedding.hashing_embedder(16)
    store = Store(spark, root, bucket_files=4)
    run_index(spark, worktrees(spark, 20), store, e, 16, "r1", "2024-01-01")
    first, files = store.state(), bytes_of(root)
    others = {k: p for k, p in first.parts.items() if k[1] != "ws-1"}
    run_index(spark, worktrees(spark, 5, ["ws-1"]), store, e, 16, "r2", "2024-01-02")
    assert {r.collection_id: r["count"] for r in store.read("points").groupBy("collection_id").count().collect()} == {"ws-1": 5, "ws-2": 20, "ws-3": 20}
    # another dimension rebuilds one worktree; one without files any more is emptied when it is named
    run_index(spark, worktrees(spark, 5, ["ws-1"]), store, embedding.hashing_embedder(32), 32, "r3", "2024-01-03")
    assert {(r.collection_id, len(r.vector)) for r in store.read("points").collect()} == {("ws-1", 32), ("ws-2", 16), ("ws-3", 16)}
    gone = run_index(spark, worktrees(spark, 5, ["ws-1"]).limit(0), store, e, 32, "r4", "2024-01-04", collections=spark.createDataFrame([("ws-1",)], "collection_id string"))
    assert [r.deleted_files for r in gone.collect()] == [5] and set(store.state().of("points", ["ws-1"])) == set()
    assert {k: p for k, p in store.state().parts.items() if k[1] != "ws-1"} == others
    now = bytes_of(root)
    assert all(now[name] == data for name, data in files.items())


def test_one_changed_file_writes_one_bucket(spark, tmp_path):
    e = embedding.hashing_embedder(16)
    store = Store(spark, str(tmp_path / "store"), bucket_files=16)
    run_index(spark, worktrees(spark, 400, ["ws-1"]), store, e, 16, "r1", "2024-01-01")
    before = store.state()
    assert len(before.of("points")) == 32 and store.read("points").count() == 400
    run_index(spark, worktrees(spark, 400, ["ws-1"], {("ws-1", 7)}), store, e, 16, "r2", "2024-01-02")
    after = store.state()
    moved = [k for k in after.of("points") if after.of("points")[k] != before.of("points").get(k)]
    assert len(moved) == 1 and len([k for k in after.of("manifest") if after.of("manifest")[k] != before.of("manifest").get(k)]) == 1
    assert store.read("points").where("content LIKE '%changed%'").count() == 1 and store.read("points").count() == 400
    assert store.read("points", state=before).where("content LIKE '%changed%'").count() == 0  # a reader of the old state
    # Files that only old states name go, those in use stay.
    dropped = store.vacuum(older_ms=-1000)
    assert dropped >= 3 and store.read("points").count() == 400 and store.vacuum(older_ms=-1000) == 0
    names = {n for n, _ in store.files.below("data") if n.endswith(".parquet")}
    assert names == {f for p in after.parts.values() for f in p.files}


def test_runs_side_by_side(spark, tmp_path):
    """Two runs from one state: on different worktrees both survive, on the same one the second has to be repeated."""
    e, store = embedding.hashing_embedder(16), Store(spark, str(tmp_path / "store"))
    run_index(spark, worktrees(spark, 3, ["ws-1", "ws-2"]), store, e, 16, "r1", "2024-01-01")

    class Slow(Store):
        """Commits its points only after another run has come between."""

        def __init__(self, names):
            super().__init__(spark, store.root)
            self.names, self.commits = names, 0

        def commit(self, *args, **kw):
            self.commits += 1
            if self.commits == 2:
                run_index(spark, worktrees(spark, 4, self.names), store, e, 16, "between", "2024-01-03")
            return super().commit(*args, **kw)

    run_index(spark, worktrees(spark, 5, ["ws-1"]), Slow(["ws-2"]), e, 16, "r2", "2024-01-02")
    count = lambda: {r.collection_id: r["count"] for r in store.read("points").groupBy("collection_id").count().collect()}
    assert count() == {"ws-1": 5, "ws-2": 4}
    with pytest.raises(Conflict):
        run_index(spark, worktrees(spark, 6, ["ws-1"]), Slow(["ws-1"]), e, 16, "r3", "2024-01-04")
    assert count() == {"ws-1": 4, "ws-2": 4}


def test_the_log(spark, tmp_path, monkeypatch):
    from semindex.sources import commits

    monkeypatch.setattr(commits, "FULL_EVERY", 3)
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda c, *p: spark.createDataFrame([(c, x, 1) for x in p], "collection_id string, file_path string, n int")
    assert store.read("t") is None and store.state().number == 0
    for c in ("odd name/with=signs", "b", "c", "b", "d"):
        store.replace_collections(rows(c, "x", "y"), "t")
    assert store.state().number == 5 and "00000000000000000003.full" in store.files.names("log")
    assert {(r.collection_id, r.file_path) for r in store.read("t").collect()} == {(c, p) for c in ("odd name/with=signs", "b", "c", "d") for p in "xy"}
    assert store.read("t", ["b"]).count() == 2 and store.read("t", state=store.state(1)).count() == 2
    store.vacuum(older_ms=-1000)
    assert store.state().number == 5 and store.read("t").count() == 8
    # The general way of creating a file exclusively, which other file systems than a local one take.
    files = Files(spark, str(tmp_path / "x"))
    files.local = False
    assert files.create("log/1", "one") and not files.create("log/1", "two") and files.read("log/1") == "one"


def test_a_run_over_a_folder_opens_what_its_listing_says(spark, tmp_path):
    from semindex.jobs.index import run_tree
    from semindex.sources.corpus import read_corpus

    root, e = tmp_path / "tree", embedding.hashing_embedder(16)
    (root / "src dir").mkdir(parents=True)
    text = lambda word: f"{word} words of a file that is long enough to be kept as a block\n" * 3
    for i in range(30):
        (root / "src dir" / f"f{i} %.ts").write_text(text(i))
    (root / "big.ts").write_text("x" * 5000)
    (root / "a.bin").write_text(text("no"))
    store = Store(spark, str(tmp_path / "store"), bucket_files=4)
    go = lambda n, **kw: run_tree(spark, str(root), store, e, 16, n, "2024-01-01", 4000, **kw)
    same = lambda: ids(store.read("points")) == ids(rebuild_index(read_corpus(spark, str(root), 4000), e).points)
    assert go("r1").first().processed_files == 30 and same()
    assert go("r2") is None
    first = store.state()
    (root / "src dir" / "f3 %.ts").write_text(text("changed"))
    (root / "src dir" / "f4 %.ts").unlink()
    (root / "new.md").write_text("# T\n" + text("md"))
    # All other files would fail to be read as they are: their bytes are gone, size and time are not.
    others = [root / "src dir" / f"f{i} %.ts" for i in range(10, 30)]
    held = {p: (p.read_bytes(), os.stat(p).st_mtime_ns) for p in others}
    for p, (data, at) in held.items():
        p.write_bytes(b"?" * len(data))
        os.utime(p, ns=(at, at))
    row = go("r3").first()
    assert (row.processed_files, row.deleted_files) == (2, 1)
    for p, (data, at) in held.items():
        p.write_bytes(data)
        os.utime(p, ns=(at, at))
    assert same()
    state = store.state()
    kept = [k for k in first.parts if k[0] == "points" and state.parts.get(k) == first.parts[k]]
    assert len(kept) >= len(state.of("points")) - 3
    others[0].write_bytes(b"other words " * (len(held[others[0]][0]) // 12) + b"x" * (len(held[others[0]][0]) % 12))
    os.utime(others[0], ns=(held[others[0]][1],) * 2)
    assert go("r4") is None and go("r5", full=True).first().processed_files == 1 and same()


def test_vectors_without_groups_send_few_hits(spark, tmp_path):
    """Of such vectors codes exclude few, but a task hands on a query's best alone, and nine in ten are found."""
    rng = np.random.default_rng(4)
    rows = [("c", f"p{i}", "", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    points = spark.createDataFrame(rows, "collection_id string, point_id string, file_path string, vector array<float>")
    asked = spark.createDataFrame([(i, None, None, 10, rows[i * 20][3]) for i in range(100)], "query_id long, collection_id string, path_prefix string, max_results int, vector array<float>")
    index = vector_index.build(points, str(tmp_path / "i"))
    near = index.approximate(asked, min_score=0.05)
    key = lambda df: {(r.query_id, r.point_id) for r in df.collect()}
    want = key(search.topk_search(points, asked, min_score=0.05))
    assert len(want) == 1000 and len(key(near.hits) & want) >= 900 and near.compared < near.all_pairs
    probing, stored = index.probing(asked, index.probes), index.points(spark)
    sent = index.near(stored, search.query_blocks(probing, 10), 0.05).where("query_id IS NOT NULL").count()
    assert 1000 <= sent <= 1000 * stored.rdd.getNumPartitions()


def test_scores_at_once_are_bounded():
    assert [len(t) for t in search.tiles(list(range(70)), search.TILE // 32)] == [32, 32, 6]
    assert [len(t) for t in search.tiles([1, 2], 10 * search.TILE)] == [1, 1]


def test_of_equal_scores_those_of_the_least_ids_are_kept():
    ids = pa.array([f"p{i}" for i in range(12)])
    scores, at = search.best_of(np.array([0.5] * 11 + [0.9]), np.arange(12), 3, ids)
    assert [(s, ids[int(i)].as_py()) for s, i in zip(scores, at, strict=True)] == [(0.9, "p11"), (0.5, "p0"), (0.5, "p1")]


def test_what_makes_a_table_runs_once_and_its_files_are_not_listed_one_by_one(spark, tmp_path, monkeypatch):
    seen, store = spark.sparkContext.accumulator(0), Store(spark, str(tmp_path / "store"), bucket_files=4)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    names = ("ws 1", "ws%2", "3")
    rows = [(c, f"f{i}.ts", f"{c}-{i}") for c in names for i in range(40)]
    shape = "collection_id string, file_path string, point_id string"
    monkeypatch.setattr(store.files, "below", lambda folder: pytest.fail("the driver lists files"))
    store.replace_collections(spark.createDataFrame(rows, shape).mapInArrow(run, shape), "points")
    assert seen.value == len(rows)
    parts = store.state().of("points")
    assert {c for c, _ in parts} == set(names) and sum(p.rows for p in parts.values()) == len(rows) and len(parts) > 20
    assert sorted(map(tuple, store.read("points").select("collection_id", "file_path", "point_id").collect())) == sorted(rows)
    assert store.write_parts(spark.createDataFrame([], f"{shape}, bucket int"), "points") == {}
