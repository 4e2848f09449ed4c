"""What the training-data operators share: table access, shared folders, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.sources.shared import saved, shared_folder, small_batches

__all__ = ["saved", "shared_folder", "small_batches"]

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; none for null."""
    return text.encode().split() if text else []


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 4000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows or ``size`` bytes, small ones put together and large ones cut: what works on many
    documents at once, or on what recurs in them, gains by it, within bounds of memory."""
    held: list[pa.RecordBatch] = []
    n = nbytes = 0
    for batch in batches:
        wait = [batch]
        while wait:
            part = wait.pop()
            if part.nbytes > size and part.num_rows > 1:
                half = part.num_rows // 2
                wait += [part.slice(half), part.slice(0, half)]
                continue
            held.append(part)
            n, nbytes = n + part.num_rows, nbytes + part.nbytes
            if n >= rows or nbytes >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n, nbytes = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id as text; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
