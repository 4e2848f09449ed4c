"""Keeping the points table in step: deletes, upserts, run markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semindex.functions import columns as C
from semindex.operators.diff import KEYS


def delete_points(points: DataFrame, paths: DataFrame, prefix: bool = False) -> DataFrame:
    """Without the points of these paths; with ``prefix`` also of what lies below them."""
    if not prefix:
        return points.join(paths.select(*KEYS).distinct(), KEYS, "left_anti")
    # Each point looks up the paths above it, so the join is by equality.
    gone = paths.select("collection_id", F.array_join(C.path_segments("file_path"), "/").alias("_above")).distinct()
    parts = C.path_segments("file_path")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = points.select("point_id", "collection_id", F.explode(above).alias("_above")).join(gone, ["collection_id", "_above"], "left_semi").select("point_id").distinct()
    return points.join(hit, "point_id", "left_anti")


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows win by point_id."""
    return old.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)


def mark_run(runs: DataFrame, collections: DataFrame, run_id: str, at: str, complete: bool, dim: int) -> DataFrame:
    """runs with a marker per collection: incomplete when a run starts, complete when its manifest is saved."""
    when = F.lit(at).cast("timestamp")
    new = collections.select("collection_id").distinct().select("collection_id", F.lit(run_id).alias("run_id"), F.lit(complete).alias("indexing_complete"), when.alias("started_at"), F.when(F.lit(complete), when).alias("completed_at"), F.lit(dim).alias("vector_dim"))
    return runs.join(new.select("collection_id", "run_id"), ["collection_id", "run_id"], "left_anti").unionByName(new)


def has_indexed_data(point_counts: DataFrame, runs: DataFrame) -> DataFrame:
    """Per collection with points: whether it can be searched, that is, its newest marker is complete or there is none."""
    last = runs.groupBy("collection_id").agg(F.max_by("indexing_complete", "started_at").alias("complete"), F.max("completed_at").alias("completed_at"))
    out = point_counts.join(last, "collection_id", "full_outer").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    return out.withColumn("has_data", (F.col("n_points") > 0) & F.coalesce("complete", F.lit(True)))
