"""Index health: assessments and the differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semindex.functions import constants as K

RECENT_MIN, STALE_MIN, MANY = 5, 60, 50


def age_text(at: Column, now: Column) -> Column:
    minutes = F.greatest(F.lit(0), F.floor((F.unix_millis(now) - F.unix_millis(at)) / 60000)).cast("string")
    return F.when(at.isNull(), "never").otherwise(F.concat(minutes, F.lit("m ago")))


def assess_modes(health: DataFrame, now: Column) -> DataFrame:
    """Three rows per collection (mode, severity, explanation) from has_indexed_data() joined with dry_run(); null diff counts mean it was skipped."""
    pending = F.col("changed_files") + F.col("new_files") + F.col("deleted_files")
    minutes = (F.unix_millis(now) - F.unix_millis("completed_at")) / 60000
    age = age_text(F.col("completed_at"), now)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    row = lambda mode, severity, explanation: F.struct(F.lit(mode).alias("mode"), F.lit(severity).alias("severity"), explanation.alias("explanation"))
    ready = (F.col("n_points") > 0) & F.coalesce("complete", F.lit(True))
    disabled = F.when(ready, row("disabled", "ok", text(K.SAYS_READY[0], F.col("n_points"), K.SAYS_READY[1]))).otherwise(
        row("disabled", "problem", F.lit(K.SAYS_MISSING))
    )
    query = (
        F.when(pending.isNull(), row("query", "warning", F.lit(K.SAYS_SKIPPED)))
        .when(pending == 0, row("query", "ok", F.lit(K.SAYS_FRESH)))
        .when(pending < MANY, row("query", "warning", text(pending, K.SAYS_PENDING, F.col("estimated_batches"), " embedding batches).")))
        .otherwise(row("query", "problem", text(pending, K.SAYS_PENDING, F.col("estimated_blocks"), " blocks, ~", F.col("estimated_batches"), " embedding batches).")))
    )
    background = (
        F.when(F.col("completed_at").isNull(), row("background", "problem", F.lit(K.SAYS_NEVER)))
        .when(pending.isNull(), row("background", "warning", text(K.SAYS_UNKNOWN[0], age, K.SAYS_UNKNOWN[1])))
        .when((pending == 0) & (minutes <= RECENT_MIN), row("background", "ok", text(K.SAYS_CAUGHT_UP[0], age, K.SAYS_CAUGHT_UP[1])))
        .when((pending > 0) & (minutes >= STALE_MIN), row("background", "problem", text(K.SAYS_STALE[0], pending, K.SAYS_STALE[1], age, K.SAYS_STALE[2])))
        .otherwise(row("background", "warning", text(pending, K.SAYS_WAITING[0], age, K.SAYS_WAITING[1])))
    )
    return health.select("collection_id", F.explode(F.array(disabled, query, background)).alias("a")).select("collection_id", "a.*")


def search_reasons(health: DataFrame, requests: DataFrame, summary: DataFrame) -> DataFrame:
    """What a search tells of the index, per collection and mode: (collection_id, mode, performed, triggered, reason).

    health as of has_indexed_data(); requests (collection_id) are refreshes that run or wait; summary as of index_summary(). With
    ``disabled`` the index is used as it is, with ``background`` a refresh is asked for, with ``query`` the run's own reason holds.
    """
    waiting = requests.select("collection_id").distinct().withColumn("_waiting", F.lit(True))
    known = health.select("collection_id", F.coalesce("has_data", F.lit(False)).alias("_ready")).join(waiting, "collection_id", "left")
    known = known.join(summary.select("collection_id", "performed", "triggered", "reason"), "collection_id", "left")
    row = lambda mode, performed, triggered, reason: F.struct(F.lit(mode).alias("mode"), performed.alias("performed"), triggered.alias("triggered"), reason.alias("reason"))
    no, yes, says = F.lit(False), F.lit(True), lambda k: F.lit(K.SEARCH_REASONS[k])
    disabled = row("disabled", no, no, F.when(F.col("_ready"), says("ready")).otherwise(says("missing")))
    background = row("background", no, yes, F.when(F.col("_waiting"), says("scheduled")).otherwise(says("idle")))
    query = row("query", F.coalesce("performed", no), F.coalesce("triggered", no), F.coalesce("reason", F.lit(K.RUN_REASONS["fresh"])))
    return known.select("collection_id", F.explode(F.array(disabled, background, query)).alias("a")).select("collection_id", "a.*")


def watch_deltas(snapshots: DataFrame) -> DataFrame:
    """snapshots (key, at, points, cache_entries, indexing_complete) with their change against the one before; none for the first."""
    order = Window.partitionBy("key").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    less = lambda c: F.coalesce(F.col(c) - before(c), F.lit(0))
    flip = F.coalesce(F.col("indexing_complete") != before("indexing_complete"), F.lit(False))
    return snapshots.withColumns({"points_delta": less("points"), "cache_delta": less("cache_entries"), "completion_changed": flip})


def watch_totals(snapshots: DataFrame) -> DataFrame:
    """First against last snapshot of each key."""
    gone = lambda c: F.max_by(c, "at") - F.min_by(c, "at")
    return snapshots.groupBy("key").agg(
        F.count("*").alias("n_snapshots"), gone("points").alias("points_delta"), gone("cache_entries").alias("cache_delta"),
        (F.max_by("indexing_complete", "at") != F.min_by("indexing_complete", "at")).alias("completion_changed"),
    )
