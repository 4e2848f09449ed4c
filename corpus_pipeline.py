"""The corpus pipeline: quality rules, near duplicates, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``. What each does to nulls, empty and repeated rows stands in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semindex.llm import mixing, neardup, pieces, quality, substring
from semindex.llm.common import saved

STAGES = [
    ("quality_rules", quality.kept_only),
    ("minhash_near_dedup", neardup.one_of_each),
    ("substring_dedup", substring.without_repeats),
    ("mix_sources", mixing.in_mixed_order),
    ("sentencepiece_encode", pieces.encoded_documents),
]

#: zstandard ratios, alignments and lattices have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
