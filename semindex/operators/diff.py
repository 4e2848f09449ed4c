"""Change detection and what is reported of it. Content never takes part in the join, only paths and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semindex.functions import columns as C
from semindex.functions import constants as K

KEYS = ["collection_id", "file_path"]


def hashed(files: DataFrame, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Slim rows: path, hash; a file over the size cap is known, but has no hash."""
    small = F.col("size_bytes") <= max_bytes
    return files.select(*KEYS, F.when(small, C.sha256("content")).alias("file_hash"), (~small).alias("oversize"))


def change_diff(files: DataFrame, manifest: DataFrame, max_bytes: int = K.MAX_FILE_BYTES, collections: DataFrame | None = None) -> DataFrame:
    """(collection_id, file_path, change): new, changed, unchanged, deleted, skipped (oversize).

    Only manifest rows of ``collections`` take part, by default those that have files: what a run doesn't look at isn't deleted.
    Name a collection whose files have all gone.
    """
    now = hashed(files, max_bytes).withColumn("_now", F.lit(True))
    looked_at = (files if collections is None else collections).select("collection_id").distinct()
    before = manifest.select(*KEYS, F.col("file_hash").alias("_before")).join(looked_at, "collection_id", "left_semi")
    change = (
        F.when(F.col("_now").isNull(), "deleted").when(F.col("oversize"), "skipped").when(F.col("_before").isNull(), "new")
        .when(F.col("_before") != F.col("file_hash"), "changed").otherwise("unchanged")
    )
    return now.join(before, KEYS, "full_outer").select(*KEYS, change.alias("change"), "file_hash")


def delete_set(diff: DataFrame, include_new: bool = False) -> DataFrame:
    """Paths whose points go: deleted and changed ones; with ``include_new`` also what an interrupted run may have left."""
    kinds = ["deleted", "changed"] + (["new"] if include_new else [])
    return diff.where(F.col("change").isin(*kinds)).select(*KEYS).distinct()


def index_summary(diff: DataFrame, n_blocks: DataFrame, adopted: DataFrame | None = None) -> DataFrame:
    """A row per collection. ``n_blocks`` (collection_id, n_blocks) counts what was indexed; ``adopted`` names collections with points but no manifest."""
    count = lambda *kinds: F.sum(F.col("change").isin(*kinds).cast("long"))
    out = diff.groupBy("collection_id").agg(count("new", "changed").alias("processed_files"), count("unchanged", "skipped").alias("skipped_files"), count("deleted").alias("deleted_files"))
    out = out.join(n_blocks, "collection_id", "left").withColumn("indexed_blocks", F.coalesce("n_blocks", F.lit(0)).cast("long")).drop("n_blocks")
    held = (adopted.select("collection_id").distinct() if adopted is not None else out.select("collection_id").limit(0)).withColumn("_adopted", F.lit(True))
    out = out.join(held, "collection_id", "left")
    work = (F.col("processed_files") > 0) | (F.col("deleted_files") > 0)
    reason = (
        F.when(work & F.col("_adopted"), K.RUN_REASONS["adopted_applied"]).when(work, K.RUN_REASONS["applied"])
        .when(F.col("_adopted"), K.RUN_REASONS["adopted"]).otherwise(K.RUN_REASONS["fresh"])
    )
    return out.withColumns({"performed": work, "triggered": work, "reason": reason, "indexed_blocks": F.when(work, F.col("indexed_blocks")).otherwise(0)}).drop("_adopted")


def dry_run(diff: DataFrame, block_counts: DataFrame) -> DataFrame:
    """What a refresh would do, per collection; skipped are oversize files only. ``block_counts`` has a row per file that would be chunked."""
    count = lambda kind: F.sum((F.col("change") == kind).cast("long"))
    todo = diff.where(F.col("change").isin("new", "changed")).join(block_counts, KEYS).groupBy("collection_id").agg(F.sum("n_blocks").alias("estimated_blocks"))
    out = diff.groupBy("collection_id").agg(count("changed").alias("changed_files"), count("new").alias("new_files"), count("deleted").alias("deleted_files"), count("skipped").alias("skipped_files"))
    blocks = F.coalesce("estimated_blocks", F.lit(0)).cast("long")
    return out.join(todo, "collection_id", "left").withColumns({"estimated_blocks": blocks, "estimated_batches": F.ceil(blocks / K.BATCH_BLOCKS).cast("long")})
