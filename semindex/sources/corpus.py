"""Corpora: from files and from tables; manifests; versioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semindex.functions import columns as C
from semindex.functions import constants as K
from semindex.sources.commits import Files, Store
from semindex.sources.shared import saved


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """Of a plain path or a URI: the file system, and the folder in it."""
    return pafs.FileSystem.from_uri(root.rstrip("/") if "://" in root or not root.startswith("file:") else "file://" + root[5:].rstrip("/"))


def list_corpus(spark: SparkSession, root: str, max_bytes: int = K.MAX_FILE_BYTES, extensions: tuple[str, ...] = K.EXTENSIONS, depth: int = 256) -> DataFrame:
    """Text files below a folder as they are listed, none opened: collection_id, file_path, resolved_path, size_bytes, modified.

    Folders are listed by tasks, level by level; names that begin with a dot or an underscore, which Spark's own readers leave
    out, are files like others (``__init__.py``, ``.github``). ``root`` is a plain path or a URI that driver and executors share.
    """
    known = frozenset(extensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(folder))
                kept = [f for f in found if f.type == pafs.FileType.Directory or f.type == pafs.FileType.File and f.size <= max_bytes and f".{f.extension}".lower() in known and f.base_name != f".{f.extension}"]
                arrays = [pa.array([f.path for f in kept], pa.string()), pa.array([f.type == pafs.FileType.Directory for f in kept], pa.bool_()), pa.array([f.size or 0 for f in kept], pa.int64()), pa.array([(f.mtime_ns or 0) // 1000 for f in kept], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "folder", "size_bytes", "us"])

    _, base = file_system(root)
    front, out = spark.createDataFrame([(base,)], "path string"), None
    for _ in range(depth):
        level = saved(front.mapInArrow(run, "path string, folder boolean, size_bytes long, us long"), "level")
        out = level if out is None else out.unionByName(level)
        front = level.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
        if front.isEmpty():
            break
    else:
        raise ValueError(f"folders are deeper than {depth}")
    plain = F.lit(base)
    return out.where("NOT folder").select(
        C.collection_id(plain).alias("collection_id"), C.relative_path("path", plain).alias("file_path"), F.col("path").alias("resolved_path"), "size_bytes", F.timestamp_micros("us").alias("modified"),
    )


def read_corpus(spark: SparkSession, root: str, max_bytes: int = K.MAX_FILE_BYTES, extensions: tuple[str, ...] = K.EXTENSIONS) -> DataFrame:
    """Text files below a folder: collection_id, file_path, resolved_path, size_bytes, content.

    Extension and size are tested on the listing, so other files are not opened.
    """
    listed = list_corpus(spark, root, max_bytes, extensions).drop("modified")
    return with_contents(listed.repartition(spark.sparkContext.defaultParallelism), root).where("content IS NOT NULL")


def with_contents(listed: DataFrame, root: str) -> DataFrame:
    """Rows of a listing with ``content``, each file read by the task that has its row; null if it has gone meanwhile."""
    names = [*listed.columns, "content"]
    at = listed.columns.index("resolved_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = []
                for path in part.column(at).to_pylist():
                    try:
                        with fs.open_input_stream(path) as f:
                            texts.append(f.read().decode("utf-8", "replace"))
                    except FileNotFoundError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return listed.mapInArrow(run, T.StructType([*listed.schema.fields, T.StructField("content", T.StringType())]))


def corpus_from_table(df: DataFrame, worktree: Column, file_path: Column, content: Column, resolved_path: Column | None = None) -> DataFrame:
    """The same columns from a table with a row per file."""
    resolved = resolved_path if resolved_path is not None else F.concat_ws("/", worktree, file_path)
    return df.select(
        C.collection_id(worktree).alias("collection_id"), file_path.alias("file_path"), resolved.alias("resolved_path"),
        F.octet_length(F.coalesce(content, F.lit(""))).cast("long").alias("size_bytes"), F.coalesce(content, F.lit("")).alias("content"),
    )


def parse_manifest(df: DataFrame, json_column: str = "value") -> DataFrame:
    """(collection_id, file_path, file_hash) from JSON objects path -> hash; malformed ones and values that aren't strings are left out."""
    entries = F.from_json(json_column, "map<string,string>", {"mode": "PERMISSIVE"})
    raw = df.select("collection_id", json_column, F.explode(entries).alias("file_path", "file_hash"))
    # from_json turns numbers into text; a hash is 64 hex digits, so what else a value may be falls away here.
    return raw.where(F.col("file_hash").rlike(r"^[0-9a-f]{64}\z")).select("collection_id", "file_path", "file_hash")


def read_manifest_json(spark: SparkSession, path: str, collection_id: str) -> DataFrame:
    return parse_manifest(spark.read.text(path, wholetext=True).withColumn("collection_id", F.lit(collection_id)))


def manifest_json(manifest: DataFrame, files: int = 10_000) -> DataFrame:
    """(collection_id, value): JSON objects path -> hash of about ``files`` files each, for export; a larger collection has several."""
    sizes = manifest.groupBy("collection_id").agg(F.ceil(F.count("*") / files).alias("_n"))
    part = manifest.join(sizes, "collection_id").withColumn("_part", F.pmod(F.xxhash64("file_path"), F.col("_n")))
    pairs = F.sort_array(F.collect_list(F.struct("file_path", "file_hash")))
    return part.groupBy("collection_id", "_part").agg(F.to_json(F.map_from_entries(pairs)).alias("value")).drop("_part")


def save_version(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version of a table beside the old ones, then names it under the next number; readers never see half of it.
    Of two writers at once the one that comes second gets the later number."""
    files, version = Files(df.sparkSession, folder), f"{folder}/v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(version)
    n = max(_numbers(files), default=0) + 1
    while not files.create(f"pointer/{n:020}", version):
        n += 1
    return version


def _numbers(files: Files) -> list[int]:
    return [int(x) for x in files.names("pointer") if x.isdigit()]


def load_version(spark: SparkSession, folder: str, *missing: None) -> DataFrame | None:
    """The newest version; of a table that was never saved an error, or ``missing`` if it is given."""
    files = Files(spark, folder)
    numbers = _numbers(files)
    if not numbers:
        if missing:
            return missing[0]
        raise FileNotFoundError(folder)
    return spark.read.parquet(files.read(f"pointer/{max(numbers):020}"))


def write_points(points: DataFrame, folder: str) -> None:
    """Replaces the rows of the collections that ``points`` has rows of, in one commit of the store ``folder``; all others stay as they are."""
    Store(points.sparkSession, folder).replace_collections(points, "points")
