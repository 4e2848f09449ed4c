"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; together they bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where that setting is absent (tests, a laptop) a temporary folder takes its place and becomes the
    session's checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            held = f"file://{tempfile.mkdtemp(prefix='semindex-')}"
            spark.sparkContext.setCheckpointDir(held)
        base = held
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors, runs what made it once."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """df, saved, with ``part`` and ``place``: rows in ranges of ``order`` that follow each other, and each row's number within its range.
    A key of any size spans as many ranges as it fills, so what goes along an order can be done range by range with a carry."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    sorted_rows = dealt.sortWithinPartitions(*order)
    return saved(sorted_rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ranges")
