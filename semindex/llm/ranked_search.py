"""Ranked lexical search: every item of a table against all documents, by integer scores over postings.

One Python pass counts the terms of each whole document. Postings are its rows (term, document, share of the term), for
terms that some item asks for. They are dealt by document, so a frequent term is spread over all shards, and a task adds up
what all of an item's terms give a document and keeps each item's best before anything more is shuffled. Item terms are
joined by their number; Spark broadcasts them if the written table is small and shuffles them otherwise.

Integers are exact: a document's length norm goes through a decimal, so it holds for corpora of any size.

Defined cases: null text has no terms; rows that repeat an id or a text are documents of their own, equal scores go by
doc_id (null last) and then by row; every row of the items table is an item; an item without terms, or whose terms no
document has, gives no rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semindex.llm.common import map_batches, saved, table

TOP, SHARD_POSTINGS = 10, 500_000
#: Of ASCII, digits and letters belong to terms.
GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
BLANKS = bytes.maketrans(GAPS, b" " * len(GAPS))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(BLANKS).split() if text else []


def forward(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, text), saved: (_row, key, n, terms, counts). ``_row`` tells rows apart that have everything in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, terms, counts = [], [0], [], []
            for text in batch.column(2):
                held = Counter(terms_of(text.as_py()))
                n.append(held.total())
                terms += held
                counts += held.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["_row", key, "n", "terms", "counts"])

    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(key).cast("long"), "text")
    return saved(map_batches(numbered, run, f"_row long, {key} long, n long, terms array<string>, counts array<int>"), "forward")


def pairs(documents: DataFrame, *columns: str) -> DataFrame:
    held = documents.select(*columns, F.explode(F.arrays_zip("terms", "counts")).alias("_x"))
    return held.select(*columns, F.col("_x.terms").alias("term"), F.col("_x.counts").cast("long").alias("tf"))


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """docs (doc_id, text), items (item_id, text): (item_id, rank, doc_id, score), the ``top`` documents of each item."""
    documents, asking = forward(docs, "doc_id"), forward(items, "item_id")
    asked = saved(pairs(asking, "_row").select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_no")), "asked")
    n_docs, n_terms = documents.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    div = lambda x, y: F.call_function("div", x, y)
    norm = 10 + div((90 * F.col("n")).cast("decimal(19,0)") * F.lit(n_docs).cast("decimal(19,0)"), F.lit(max(n_terms, 1)).cast("decimal(19,0)"))
    share = div(F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 8 * F.col("m"))
    held = pairs(documents.where("n > 0").withColumn("m", norm), "_row", "doc_id", "m").join(asked, "term").select("_row", "doc_id", "term_no", share.alias("share"))
    df = saved(pairs(documents, "_row").join(asked, "term").groupBy("term_no").agg(F.count("*").alias("df")), "df")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    wanted = saved(pairs(asking, "_row").join(asked, "term").join(df, "term_no").select(F.col("_row").alias("_item"), "term_no", weight.alias("w")).where("w > 0"), "wanted")
    n_postings = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shards = max(1, -(-n_postings // SHARD_POSTINGS))
    # A document's postings meet in one task, which so adds up its scores and ranks them: no sums are shuffled but each task's best.
    postings = held.repartition(shards, "_row")
    score = postings.join(wanted, "term_no").groupBy("_item", "doc_id", "_row").agg(F.sum(F.col("w") * F.col("share")).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_row"))
    best = score.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(asking.select(F.col("_row").alias("_item"), "item_id"), "_item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents
), s AS (
  SELECT count(*)::bigint AS big_n, sum(len(t))::bigint AS big_l FROM d WHERE len(t) > 0
), p AS (
  SELECT doc_id, n, term, count(*)::bigint AS tf FROM (SELECT doc_id, len(t)::bigint AS n, unnest(t) AS term FROM d) GROUP BY ALL
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM p, s GROUP BY term
), x AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::bigint AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL
)
SELECT item_id, row_number() OVER o AS rank, doc_id, score FROM x WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= {TOP}"""
