"""Tables that are derived from the driver's tables by rule, in Spark here and in SQL for the oracle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.functions import columns as C
from semindex.sources.corpus import corpus_from_table

DIRS = ("src/auth", "src/orders", "docs", "pkg/docs", "node_modules/x", ".github", ".hidden")
EXTS = (".md", ".ts", ".py", ".swift", ".vb", ".json", ".txt", ".log", ".markdown", ".elm")
RULES = (".*", ".*/**", "!.github", "!.github/**", "node_modules/**", "src/auth/", "*.log", "!src/auth/src1/", "docs/src2*")
PREFIXES = (None, ".", "src", "./src/auth/", "/pkg", "src\\orders", "sr", "docs/../src")
MODELS = ("text-embedding-3-small", "nomic-embed-code", "gemini-embedding-001", "codestral-embed-2505", "all-minilm", "unknown", "amazon.titan-embed-text-v2:0", "qwen/qwen3-embedding-4b", "google/text-embedding-005")
PROVIDERS = ("openai", "ollama", "gemini", "mistral", "none", "bedrock", "openrouter", "vercel-ai-gateway", "openai-compatible")
SIZE_CAP = 8000
NOW = "2024-02-01 00:00:00"

listed = lambda xs: "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in xs) + "]"

FILES_SQL = f"""
files AS (
  SELECT 'ws-' || substr(sha256('/w/' || lang), 1, 16) AS collection_id,
    {listed(DIRS)}[doc_id % 7 + 1] || '/' || source || '/f' || doc_id || {listed(EXTS)}[doc_id % 10 + 1] AS file_path,
    doc_id, '/w/' || lang AS worktree, coalesce(text, '') AS content, strlen(coalesce(text, '')) AS size_bytes
  FROM documents
)"""

MANIFEST_SQL = f"""
{FILES_SQL.strip()}, prev_manifest AS (
  SELECT collection_id, file_path, CASE WHEN doc_id % 13 = 0 THEN sha256(content || '#') ELSE sha256(content) END AS file_hash
  FROM files WHERE doc_id % 11 <> 0
  UNION ALL
  SELECT collection_id, file_path || '.old', sha256(content) FROM files WHERE doc_id % 17 = 0
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: tuple[str, ...], at: F.Column) -> F.Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (at + 1).cast("int"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of four worktrees; doc_id stays as a helper column."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(pick(DIRS, F.col("doc_id") % 7), F.lit("/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), pick(EXTS, F.col("doc_id") % 10))
    worktree = F.concat(F.lit("/w/"), F.col("lang"))
    columns = docs.select("doc_id", "text", worktree.alias("worktree"), path.alias("file_path"))
    out = corpus_from_table(columns, F.col("worktree"), F.col("file_path"), F.col("text"))
    return out.withColumn("doc_id", F.regexp_extract("file_path", r"/f(\d+)\.[a-z]+\z", 1).try_cast("long"))


def prev_manifest(files: DataFrame) -> DataFrame:
    """What an earlier run has left: some files missing, some changed, some since deleted."""
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit("#"))).otherwise(F.col("content"))
    kept = files.where("doc_id % 11 <> 0").select("collection_id", "file_path", C.sha256(text).alias("file_hash"))
    old = files.where("doc_id % 17 = 0").select("collection_id", F.concat("file_path", F.lit(".old")).alias("file_path"), C.sha256("content").alias("file_hash"))
    return kept.unionByName(old)


def write_files(files: DataFrame, root: str) -> None:
    """Each row (file_path, content) as a file below ``root``, a folder that driver and executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fs.create_dir(f"{folder}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{folder}/{path}") as f:
                    f.write(content.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("file_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
