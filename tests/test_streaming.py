import datetime
import os

from pyspark.sql import functions as F

from semindex.functions import columns as C
from semindex.jobs.index import apply_changes, rebuild_index
from semindex.operators import embedding, status
from semindex.sources.commits import Store
from semindex.streaming import changes, triggers


def test_stream_fires_what_the_batch_twin_fires(spark, tmp_path):
    rows = [(i, f"/w/{i % 3}", ("session.idle", "file.watcher.updated", "other")[i % 7 % 3], 1_700_000_000 + i * (i % 5) * 2 + i) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, worktree string, event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    folder = str(tmp_path / "in")
    events.where("event_id < 70").coalesce(1).write.parquet(folder)
    events.where("event_id >= 70").coalesce(1).write.mode("append").parquet(folder)
    # A last event, hours later, moves the watermark past all deadlines.
    late = spark.createDataFrame([(999, "/w/9", "session.idle", 1_700_100_000)], "event_id long, worktree string, event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    late.coalesce(1).write.mode("append").parquet(folder)
    normal, urgent = 9000, 2000
    want = sorted(tuple(r) for r in triggers.debounce(triggers.watched_events(events), normal, urgent).collect())
    stream = triggers.watched_events(spark.readStream.schema(events.schema).parquet(folder))
    query = triggers.debounce_stream(stream, "1 hour", normal, urgent).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("fired").collect() if r.worktree != "/w/9")
    assert got == want


def test_streamed_changes_make_the_index_that_a_batch_makes(spark, tmp_path):
    """Files of two worktrees come, change and go; batches take only what differs, and one that is replayed changes nothing."""
    text = lambda word: f"{word} words of a file that is long enough to be kept as a block\n" * 3
    root, store, embedder = tmp_path / "trees", str(tmp_path / "store"), embedding.hashing_embedder(16)
    for tree in "ab":
        (root / tree / "src").mkdir(parents=True)
        (root / tree / "node_modules").mkdir()
        (root / tree / "node_modules" / "x.ts").write_text(text("ignored"))
        for i in range(4):
            (root / tree / "src" / f"f{i}.ts").write_text(text(f"{tree}{i}"))
    spark.dataSource.register(changes.WorktreeChanges)

    def go():
        rows = spark.readStream.format("worktree_changes").option("path", str(root)).option("state", str(tmp_path / "state")).load()
        query = changes.ingest(rows, store, embedder, 16, str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    go()
    first = Store(spark, store).state()
    assert Store(spark, store).read("points").count() == 8
    (root / "a" / "src" / "f0.ts").write_text(text("changed now"))
    (root / "a" / "src" / "f1.ts").unlink()
    (root / "a" / "src" / "g.md").write_text("# T\n" + text("new"))
    go()
    state = Store(spark, store).state()
    assert state.of("points", [c for _, c, _ in first.parts if c != "none"]) != first.of("points")
    files = spark.createDataFrame([(f"{root}/{t}", str(p.relative_to(root / t)), str(p), p.read_text()) for t in "ab" for p in sorted((root / t / "src").iterdir())], "w string, file_path string, resolved_path string, content string")
    end = files.select(C.collection_id("w").alias("collection_id"), "file_path", "resolved_path", F.length("content").cast("long").alias("size_bytes"), "content")
    key = lambda df: sorted((r.collection_id, r.file_path, r.point_id) for r in df.collect())
    assert key(Store(spark, store).read("points")) == key(rebuild_index(end, embedder).points)
    unmoved = end.where("file_path = 'src/f2.ts'").select("collection_id").distinct().count()
    assert unmoved == 2 and len({c for t, c, _ in state.parts if t == "points" and state.parts[t, c, 0] == first.parts[t, c, 0]}) == 1  # worktree b as it was
    # The last batch once more, as after a crash before Spark's own commit; and a batch of nothing new under another name.
    row = spark.createDataFrame([(r.collection_id, "src/f0.ts", "x.ts", 9, "other content, that comes too late " * 4) for r in end.where("file_path = 'src/g.md'").collect()], "collection_id string, file_path string, resolved_path string, size_bytes long, content string")
    assert apply_changes(spark, row, Store(spark, store), embedder, 16, "stream-1", "2024-01-01") is None
    assert Store(spark, store).state() == state
    same = apply_changes(spark, end, Store(spark, store), embedder, 16, "again", "2024-01-01")
    assert {r.reason for r in same.collect()} == {"already-fresh"} and Store(spark, store).state().of("points") == state.of("points")
    assert len(os.listdir(tmp_path / "state")) <= 2


def test_status_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [(k, 1_700_000_000 + 60 * i, 10 * i + k, i // 2, (i + k) % 4 > 1) for k in range(3) for i in range(20)]
    snapshots = spark.createDataFrame(rows, "key long, s long, points long, cache_entries long, indexing_complete boolean").withColumn("at", F.timestamp_seconds("s")).drop("s")
    folder = str(tmp_path / "in")
    for a in range(0, 20, 7):
        snapshots.where(F.unix_seconds("at").between(1_700_000_000 + 60 * a, 1_700_000_000 + 60 * (a + 6))).coalesce(1).write.mode("append").parquet(folder)
    stream = triggers.status_stream(spark.readStream.schema(snapshots.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    names = ["key", "ms", "points", "cache_entries", "indexing_complete", "points_delta", "cache_delta", "completion_changed"]
    want = status.watch_deltas(snapshots).withColumn("ms", F.unix_millis("at")).select(names)
    assert sorted(map(tuple, spark.table("deltas").select(names).collect())) == sorted(map(tuple, want.collect()))


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    schema = "event_id long, worktree string, event_type string, ts timestamp"
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC)
    folder = str(tmp_path / "in")
    steps = [[(1, "/w", "session.idle", at(0)), (2, "/w", "session.idle", at(7200))], [(3, "/x", "session.idle", at(7300))], [(4, "/w", "session.idle", at(60)), (5, "/x", "session.idle", at(30)), (6, "/y", "session.idle", at(9000))]]
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = triggers.watched_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = triggers.debounce_stream(stream, "10 minutes", 9000, 2000).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert triggers.late_rows(query.recentProgress) == 2
    fired = {(r.worktree, r.fire_ms // 1000 - 1_700_000_000) for r in spark.table("late").collect()}
    assert ("/w", 9) in fired and ("/w", 69) not in fired and ("/x", 39) not in fired


def test_late_events_are_kept(spark, tmp_path):
    """In a table of their own, as many as Spark says it would drop; requests are those of the plain stream."""
    schema = "event_id long, worktree string, event_type string, ts timestamp"
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC)
    folder = str(tmp_path / "in")
    steps = [[(1, "/w", "session.idle", at(0)), (2, "/w", "session.idle", at(7200))], [(3, "/x", "session.idle", at(7300))], [(4, "/w", "file.watcher.updated", at(60)), (5, "/x", "session.idle", at(30)), (6, "/y", "session.idle", at(9000))], [(7, "/z", "session.idle", at(20000))], [(8, "/z", "session.idle", at(20001))]]
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(folder)
    source = lambda: triggers.watched_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    plain = triggers.debounce_stream(source(), "10 minutes", 9000, 2000).writeStream.format("memory").queryName("plain").outputMode("append").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    plain.awaitTermination()
    both = triggers.in_two_tables(triggers.debounce_with_late(source(), "10 minutes", 9000, 2000), str(tmp_path / "requests"), str(tmp_path / "late"), str(tmp_path / "cp2")).trigger(availableNow=True).start()
    both.awaitTermination()
    late = sorted((r.worktree, r.reason, r.at_ms // 1000 - 1_700_000_000) for r in spark.read.parquet(str(tmp_path / "late")).collect())
    assert late == [("/w", "file.watcher.updated", 60), ("/x", "session.idle", 30)] and len(late) == triggers.late_rows(plain.recentProgress)
    got = sorted((r.worktree, r.reason, r.at_ms) for r in spark.read.parquet(str(tmp_path / "requests")).collect())
    assert got == sorted((r.worktree, r.reason, r.fire_ms) for r in spark.table("plain").collect()) and len(got) >= 3


def test_newest_request(spark):
    requests = spark.createDataFrame([("/w", "a", 1), ("/w", "b", 2)], triggers.REQUESTS)
    assert [tuple(r) for r in triggers.newest_request(requests).collect()] == [("/w", "b", 2)]


def test_one_worktree_with_all_events(spark):
    """Ranges of a hot worktree give what one pass over its events gives."""
    import random

    rng = random.Random(2)
    rows, t = [], 1_700_000_000_000
    for i in range(3000):
        t += rng.choice([0, 1, 500, 1500, 1501, 9000])
        rows.append((i, "/hot" if i % 50 else None, rng.choice(["session.idle", "file.watcher.updated", "session.created"]), t))
    events = spark.createDataFrame(rows, "event_id long, worktree string, event_type string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    want = []
    for w in ("/hot", None):
        pending, urgent = None, False
        for _, _, kind, ms in sorted((r for r in rows if r[1] == w), key=lambda r: (r[3], r[0])):
            if pending and ms >= pending[1]:
                want += [(w, *pending), *([(w, "urgent-followup", pending[1])] if urgent else [])]
                pending, urgent = None, False
            urgent |= kind == triggers.URGENT
            pending = (kind, ms + (100 if kind == triggers.URGENT else 1500))
        want += [(w, *pending), *([(w, "urgent-followup", pending[1])] if urgent else [])]
    got = triggers.debounce(triggers.watched_events(events), 1500, 100, ranges=9).select("worktree", "reason", "fire_ms").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
