"""Row filters of the scan, of blocks and of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semindex.functions import columns as C
from semindex.functions import constants as K


def filter_supported(files: DataFrame) -> DataFrame:
    """Files whose logical or resolved name has a supported extension."""
    return files.where(C.file_extension("file_path").isin(*K.EXTENSIONS) | C.file_extension("resolved_path").isin(*K.EXTENSIONS))


def filter_size(files: DataFrame, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    return files.where(F.col("size_bytes") <= max_bytes)


def not_default_ignored(path: Column | str) -> Column:
    """No directory of the path, at any depth, has one of the ignored names."""
    parts = C.path_segments(path)
    return ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(d) for d in K.IGNORED_DIRS)))


def filter_external(files: DataFrame, root: Column, follow_external: bool = True) -> DataFrame:
    """Without links that lead out of the root, unless they are to be followed."""
    inside = (F.col("resolved_path") == root) | F.startswith(F.col("resolved_path"), F.concat(root, F.lit("/")))
    return files if follow_external else files.where(inside)


def non_blank(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.length(C.trimmed("content")) > 0)


def complete_payload(points: DataFrame) -> DataFrame:
    full = (F.col("file_path") != "") & (F.col("content") != "") & (F.col("start_line") != 0) & (F.col("end_line") != 0)
    return points.where(full)
