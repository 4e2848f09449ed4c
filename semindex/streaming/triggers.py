"""Refresh triggers from editor events, in batch and as streams.

events: worktree, event_type, ts (timestamp). An event fires after its delay unless a later one of its
worktree comes first, which replaces the deadline; if any event since the last firing was urgent, a second
request follows the first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from semindex.functions import constants as K
from semindex.sources.shared import in_ranges, saved

WATCHED = ("session.created", "session.idle", "file.watcher.updated")
URGENT = "file.watcher.updated"
DELTAS = "key long, ms long, points long, cache_entries long, indexing_complete boolean, points_delta long, cache_delta long, completion_changed boolean"
REQUESTS = "worktree string, reason string, fire_ms long"


def watched_events(events: DataFrame, mode: str = "background") -> DataFrame:
    return events.where(F.col("event_type").isin(*WATCHED) & F.lit(mode == "background")).withColumn("urgent", F.col("event_type") == URGENT)


def delay_ms(normal: int, urgent: int) -> Column:
    return F.when(F.col("urgent"), F.lit(urgent)).otherwise(F.lit(normal)).cast("long")


def debounce(events: DataFrame, normal_ms: int = K.DEBOUNCE_MS, urgent_ms: int = K.URGENT_MS, follow_up: bool = True, ranges: int | None = None) -> DataFrame:
    """REQUESTS of a bounded table of watched events. Ties in time are ordered by event_id if there is one.

    Events lie in ranges of (worktree, time). Whether one fires depends on the next one, which for a range's last is the first of
    the range after; how many have fired before is the sum over earlier ranges. Only a row for each worktree and range goes
    along a whole worktree, so one that has all events is worked on by all tasks.
    """
    tie = "event_id" if "event_id" in events.columns else "event_type"
    held = events.select("worktree", "event_type", "urgent", F.unix_millis("ts").alias("ms"), F.col(tie).alias("tie")).withColumn("due", F.col("ms") + delay_ms(normal_ms, urgent_ms))
    rows = in_ranges(held, "worktree", "ms", "tie", ranges=ranges)
    firsts = rows.groupBy("worktree", "part").agg(F.min("ms").alias("first"))
    coming = firsts.select(F.col("worktree").alias("_w"), F.col("part").alias("_p"), F.lead("first").over(Window.partitionBy("worktree").orderBy("part")).alias("coming"))
    order = Window.partitionBy("worktree", "part").orderBy("place")
    same = F.col("worktree").eqNullSafe(F.col("_w")) & (F.col("part") == F.col("_p"))
    joined = rows.join(coming, same)
    after = F.coalesce(F.lead("ms").over(order), F.col("coming"))
    fired = joined.withColumn("fires", after.isNull() | (after >= F.col("due")))
    within = F.coalesce(F.sum(F.col("fires").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = saved(fired.withColumn("within", within).drop("coming", "_w", "_p"), "fires")
    sums = marked.groupBy("worktree", "part").agg(F.sum(F.col("fires").cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("worktree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select(F.col("worktree").alias("_w"), F.col("part").alias("_p"), before.alias("base"))
    numbered = marked.join(bases, same).withColumn("burst", F.col("base") + F.col("within"))
    at = F.struct("ms", "tie")
    bursts = numbered.groupBy("worktree", "burst").agg(F.max_by("event_type", at).alias("reason"), F.max_by("due", at).alias("fire_ms"), F.bool_or("urgent").alias("urgent"))
    first = bursts.select("worktree", "reason", "fire_ms")
    return first.unionByName(bursts.where("urgent").select("worktree", F.lit("urgent-followup").alias("reason"), "fire_ms")) if follow_up else first


def session_triggers(events: DataFrame, normal_ms: int = K.DEBOUNCE_MS, urgent_ms: int = K.URGENT_MS) -> DataFrame:
    """The built-in form with session windows: a session ends at its latest deadline, not its last one, so it fires no more often than debounce()."""
    gap = F.when(F.col("urgent"), F.lit(f"{urgent_ms} milliseconds")).otherwise(F.lit(f"{normal_ms} milliseconds"))
    out = events.groupBy("worktree", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"), F.bool_or("urgent").alias("urgent"))
    return out.select("worktree", F.unix_millis("s.start").alias("start_ms"), F.unix_millis("s.end").alias("fire_ms"), "n_events", "urgent")


def trigger_rate(events: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    out = events.groupBy("worktree", F.window("ts", window, slide or window).alias("w"))
    return out.agg(F.count("*").alias("n_events"), F.max_by("event_type", "ts").alias("last_type")).select("worktree", F.unix_millis("w.start").alias("start_ms"), "n_events", "last_type")


def newest_request(requests: DataFrame) -> DataFrame:
    """One refresh at a time: of the requests that wait, the newest of each worktree."""
    return requests.groupBy("worktree").agg(F.max_by("reason", "fire_ms").alias("reason"), F.max("fire_ms").alias("fire_ms"))


class Debouncer(StatefulProcessor):
    """One worktree's pending request: its reason, deadline and whether anything since the last firing was urgent.

    Events of a micro-batch are taken in time order; a gap that is long enough between them fires at once,
    the timer covers the last.
    """

    def __init__(self, normal_ms: int, urgent_ms: int, follow_up: bool):
        self.normal_ms, self.urgent_ms, self.follow_up = normal_ms, urgent_ms, follow_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "reason string, due long, urgent boolean")

    def requests(self, worktree: str, reason: str, due: int, urgent: bool) -> list[tuple]:
        return [(worktree, reason, due), *([(worktree, "urgent-followup", due)] if urgent and self.follow_up else [])]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(ms), kind) for frame in rows for ms, kind in zip(frame["ms"], frame["event_type"], strict=True))
        state = tuple(self.pending.get()) if self.pending.exists() else None
        out = []
        for ms, kind in events:
            if state and ms >= state[1]:
                out += self.requests(key[0], *state)
                state = None
            urgent = kind == URGENT
            state = (kind, ms + (self.urgent_ms if urgent else self.normal_ms), urgent or bool(state and state[2]))
        if state:
            self.pending.update(state)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(state[1])
        yield pd.DataFrame(out, columns=["worktree", "reason", "fire_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.pending.exists() and (state := tuple(self.pending.get()))[1] <= expiredTimerInfo.getExpiryTimeInMs():
            out = self.requests(key[0], *state)
            self.pending.clear()
        yield pd.DataFrame(out, columns=["worktree", "reason", "fire_ms"])

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, watermark: str = "10 minutes", normal_ms: int = K.DEBOUNCE_MS, urgent_ms: int = K.URGENT_MS, follow_up: bool = True) -> DataFrame:
    """The stream of REQUESTS; needs the RocksDB state store. Events older than the watermark are dropped (and counted in the query's progress)."""
    held = events.withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    return held.groupBy("worktree").transformWithStateInPandas(Debouncer(normal_ms, urgent_ms, follow_up), REQUESTS, "Append", "EventTime")


class LateKeeper(Debouncer):
    """A Debouncer that gets late events too, and tells them apart: an event before the watermark changes no state and comes out as it is."""

    NAMES = ("kind", "worktree", "reason", "at_ms")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        frames = list(rows)
        late = [("late", key[0], kind, int(ms)) for f in frames for ms, kind in zip(f["ms"], f["event_type"], strict=True) if ms < watermark]
        good = [f[f["ms"] >= watermark] for f in frames]
        fired = [tuple(x) for f in super().handleInputRows(key, good, timerValues) for x in f.itertuples(index=False, name=None)]
        yield pd.DataFrame(late + [("request", *x) for x in fired], columns=list(self.NAMES))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for f in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield pd.DataFrame([("request", *x) for x in f.itertuples(index=False, name=None)], columns=list(self.NAMES))


def debounce_with_late(events: DataFrame, watermark: str = "10 minutes", normal_ms: int = K.DEBOUNCE_MS, urgent_ms: int = K.URGENT_MS, follow_up: bool = True) -> DataFrame:
    """As debounce_stream(), with the events that come after the watermark as rows of kind ``late`` beside those of kind ``request``: (kind,
    worktree, reason, at_ms). The operator gets times without their watermark, so that Spark drops none, and compares them itself."""
    held = events.withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    return held.drop("ts").groupBy("worktree").transformWithStateInPandas(LateKeeper(normal_ms, urgent_ms, follow_up), "kind string, worktree string, reason string, at_ms long", "Append", "EventTime")


def in_two_tables(rows: DataFrame, requests: str, late: str, checkpoint: str) -> DataStreamWriter:
    """Writes a stream of debounce_with_late() to two folders of Parquet; a batch that is replayed replaces its own rows."""

    def write(batch: DataFrame, n: int) -> None:
        for kind, folder in (("request", requests), ("late", late)):
            batch.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def newest_files(snapshots: DataFrame) -> DataFrame:
    """The last snapshot (at) of each file of a micro-batch, columns unchanged; a deleted one has null content."""
    order = Window.partitionBy("collection_id", "file_path").orderBy(F.desc("at"))
    return snapshots.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def refresh_stream(snapshots: DataFrame, refresh: Callable[[DataFrame, str], None], checkpoint: str) -> DataStreamWriter:
    """Streams snapshots of files (collection_id, file_path, at, ...) into an index, one micro-batch at a time: ``refresh(files,
    run_id)`` gets each file once, as it was last. The run id is the micro-batch's, so a batch that is replayed after a crash is
    the same run and writes the same points."""
    return snapshots.writeStream.foreachBatch(lambda batch, n: refresh(newest_files(batch), f"batch-{n}")).option("checkpointLocation", checkpoint)


class SnapshotDeltas(StatefulProcessor):
    """The last snapshot of a key and how each new one differs from it; the first differs in nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long, points long, cache_entries long, indexing_complete boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(a), int(b), int(c), bool(d)) for frame in rows for a, b, c, d in zip(frame["ms"], frame["points"], frame["cache_entries"], frame["indexing_complete"], strict=True))
        held = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for now in new:
            before = held or now
            if now[0] >= before[0]:  # an older one than the last is late and changes nothing
                out.append((key[0], *now, now[1] - before[1], now[2] - before[2], now[3] != before[3]))
                held = now
        if held:
            self.last.update(held)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DELTAS.split(", ")])

    def close(self) -> None:
        pass


def status_stream(snapshots: DataFrame) -> DataFrame:
    """DELTAS of a stream of snapshots (key, at, points, cache_entries, indexing_complete); needs the RocksDB state store.
    One small state a key; snapshots of a micro-batch are taken in time order."""
    held = snapshots.withColumn("ms", F.unix_millis("at"))
    return held.groupBy("key").transformWithStateInPandas(SnapshotDeltas(), DELTAS, "Append", "None")


def late_rows(progress: list) -> int:
    """Rows that a query's stateful operators dropped, as its progress reports tell, because they came after the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in (p if isinstance(p, dict) else json.loads(p.json))["stateOperators"])
