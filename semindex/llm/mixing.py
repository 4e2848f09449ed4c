"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks. With weight w = q / Q (integer shares q, Q their sum), a source's
i-th block (from 0) may run from slot floor(i / w) on and must be done by slot ceil((i + 1) / w). One block
runs per slot, the one that is released and due first (ties: by source name); for one lane that meets
every deadline, so at any time a source is less than one block away from its share.

Weights given by the caller are taken exactly, as decimals: 1 : 2 has Q = 3, and Q may be of any size.
Without weights the targets are square roots of counts, rounded to 1,000 shares, or 100 a source if that is more
(one at least), as in OP1_SQL: no source is off its root by more than half a hundredth of a mean share.

Releases and deadlines repeat every Q slots, and so does the schedule. The driver lays out one period and keeps the
blocks that have rows; every row then finds its slot by arithmetic. A source that has run out leaves its slots empty, and
the others keep their order. Where weights are given and the table has fewer blocks than the period, only its
blocks are laid out, in as many turns, and a source that has run out takes no slots. So the driver walks the lesser of
both numbers, and the weights of callers whose period is longer than the table cost it a line for each block.

Order within a source: by a 12-bit hash of doc_id, then doc_id. Ranks come from counts per (source, hash
bucket), at most 4096 rows a source, and from row numbers within a bucket, so no task holds a source.

A table in mixed order is laid out in ranges of slots. A source's rows are in the order of their slots by hash, id and tie, so slim rows
tell where in this order each range begins, and a text finds its range by its own key: it is shuffled once, and gets its slot there.

Defined cases: a null source is a source of its own, before all others on ties; a null doc_id has bucket 0
and comes first there; repeated rows each get a place, equal doc_ids are ordered by a hash of the row; an
empty table gives an empty result; columns of the input keep their names, the operator's own are added
after them (and an input column of such a name is replaced).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semindex.llm.common import saved, small_batches, table

#: Rows of a block; shares that a period has about without weights, and for each source at least; sources at most, as their
#: counts and weights are held by the driver; rows that a table may have to be broadcast.
BLOCK_ROWS, SHARES, SOURCE_SHARES, MOST_SOURCES, BROADCAST_ROWS = 64, 1000, 100, 1_000_000, 11_000
#: Begins of ranges, over all sources, that may be broadcast; what orders the rows of a source.
MOST_CUTS, ORDER = 100_000, ["bucket", "doc_id", "tie"]
PLACE = ["block", "seat", "slot", "release", "deadline"]


def shares(counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None = None) -> dict[str | None, int]:
    """Integer shares, in the ratio of the weights exactly; a source of the table without a weight is an error. Without weights a
    source counts by the square root of its rows, which lifts small sources against a dominant one: SHARES in all, or SOURCE_SHARES
    a source if that is more, rounded, one at least."""
    if weights:
        if bad := [s for s in counts if not 0 < weights.get(s, 0) < math.inf]:
            raise ValueError(f"each source needs a weight that is finite and above 0: {bad[:5]}")
        exact = {s: Fraction(str(weights[s])) for s in counts}
        below = math.lcm(*(w.denominator for w in exact.values()))
        whole = {s: int(w * below) for s, w in exact.items()}
        common = math.gcd(*whole.values())
        return {s: q // common for s, q in whole.items()}
    total = max(SHARES, SOURCE_SHARES * len(counts))
    raw = {s: n**0.5 for s, n in counts.items()}
    whole = sum(raw[s] for s in sorted(raw, key=lambda s: (s is not None, s or "")))
    return {s: max(1, int(total * w / whole + 0.5)) for s, w in raw.items()}


def period(share: Mapping[str | None, int], blocks: Mapping[str | None, int] | None = None) -> list[tuple[str | None, int, int]]:
    """(source, number of its block within the period, slot): earliest deadline first among released blocks.
    With ``blocks``, the number that each source has, only these, up to the last one."""
    order = sorted(share, key=lambda s: (s is not None, s or ""))
    whole = sum(share.values())
    left = sum(min(share[s], blocks[s] if blocks else share[s]) for s in order)
    coming = [(0, n, 0) for n in range(len(order))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    out = []
    slot = 0
    while left:
        while coming and coming[0][0] <= slot:
            _, n, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * whole // share[order[n]]), n, i))
        _, n, i = heapq.heappop(ready)
        if not blocks or i < blocks[order[n]]:
            out.append((order[n], i, slot))
            left -= 1
        if i + 1 < share[order[n]]:
            heapq.heappush(coming, ((i + 1) * whole // share[order[n]], n, i + 1))
        slot += 1
    return out


def layout(share: Mapping[str | None, int], blocks: Mapping[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, block, slot) of the blocks that there are, as many turns as blocks: a source that has run out takes no slot from the
    others, and slots in which none is released are jumped over. Releases and deadlines hold as for the full schedule."""
    order = sorted(share, key=lambda s: (s is not None, s or ""))
    whole = sum(share.values())
    coming = [(0, n, 0) for n, s in enumerate(order) if blocks[s]]
    ready: list[tuple[int, int, int]] = []
    out = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            _, n, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * whole // share[order[n]]), n, i))
        _, n, i = heapq.heappop(ready)
        out.append((order[n], i, slot))
        if i + 1 < blocks[order[n]]:
            heapq.heappush(coming, ((i + 1) * whole // share[order[n]], n, i + 1))
        slot += 1
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """(row, source, ORDER): each row of docs as a struct, its source, never null, and what orders it within the source."""
    rest = [F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "source") and "map<" not in kind]
    bucket = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 3), 16, 10).cast("int"), F.lit(0))
    source = F.struct(F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"))
    return docs.select(F.struct(*docs.columns).alias("row"), source.alias("source"), "doc_id", bucket.alias("bucket"), (F.xxhash64(*rest) if rest else F.lit(0).cast("long")).alias("tie"))


def ranked(keys: DataFrame) -> DataFrame:
    """keys (source, ORDER, ...) with ``rank``, the row's number within its source from 0, and ``alike``: a row of equal keys goes before."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keys.groupBy("source", "bucket").agg(F.count("*").alias("n")).select("source", "bucket", before.alias("start"))
    own = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie")
    out = keys.withColumns({"within": F.row_number().over(own) - 1, "alike": F.row_number().over(own) != F.rank().over(own)})
    return out.join(starts, ["source", "bucket"]).withColumn("rank", F.col("start") + F.col("within")).drop("start", "within")


class Schedule:
    """The blocks of docs (source, ...): ``of`` gives rows (source, rank, ...) their PLACE; ``sent``: it broadcasts all that it joins them with."""

    def __init__(self, docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS):
        spark = docs.sparkSession
        small_batches(spark)
        found = docs.groupBy("source").count().limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        counts = {r["source"]: r["count"] for r in found}
        share = shares(counts, weights)
        blocks = {s: -(-n // block_rows) for s, n in counts.items()}
        # Shares beyond a source's blocks may not fit a long, and no row needs them: it has no second lap.
        total = sum(share.values())
        whole = total if any(blocks[s] > q for s, q in share.items()) else 0
        key = "source struct<known:boolean,name:string>"
        short = bool(weights) and sum(blocks.values()) <= total  # the table ends before the period: its blocks alone are laid out
        rows = [((s is not None, s or ""), i, slot, i * total // share[s], -(-(i + 1) * total // share[s])) for s, i, slot in (layout(share, blocks) if short else period(share, blocks))]
        plan = spark.createDataFrame(rows, f"{key}, turn long, slot long, release long, deadline long")
        each = spark.createDataFrame([((s is not None, s or ""), blocks[s] if short else min(q, blocks[s])) for s, q in share.items()], f"{key}, share long")
        # Both are broadcast up to BROADCAST_ROWS; longer ones are joined by their keys.
        sent = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
        self.sent = max(len(rows), len(share)) <= BROADCAST_ROWS
        self.each, self.plan, self.block_rows, self.lap = sent(each, len(share)), sent(plan, len(rows)), block_rows, 0 if short else whole

    def of(self, rows: DataFrame) -> DataFrame:
        block = F.floor(F.col("rank") / self.block_rows).cast("long")
        out = rows.join(self.each, "source").withColumns({"block": block, "seat": F.col("rank") % self.block_rows})
        out = out.withColumns({"turn": F.col("block") % F.col("share"), "lap": F.floor(F.col("block") / F.col("share")) * self.lap})
        out = out.join(self.plan, ["source", "turn"])
        return out.withColumns({c: F.col("lap") + F.col(c) for c in ("slot", "release", "deadline")}).drop("turn", "lap", "share")


def placed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, PLACE): each row of docs (doc_id, source, ...) as a struct, so that no name of its columns meets one of ours."""
    return Schedule(docs, weights, block_rows).of(ranked(keyed(docs))).select("row", *PLACE)


def begins(schedule: Schedule, docs: DataFrame, ranges: int) -> DataFrame | None:
    """(source, keys, parts, ranks): in the order of a source's rows, where each range of slots begins in it. None if these are more than
    MOST_CUTS, or if one begins between rows of equal keys."""
    slim = saved(schedule.of(ranked(keyed(docs).drop("row"))).select("source", *ORDER, "alike", "rank", "slot"), "places")
    bounds = slim.agg(F.percentile_approx("slot", [i / ranges for i in range(ranges)], max(10_000, 20 * ranges)).alias("b")).first()["b"]
    if not bounds:
        return None
    part = found(F.lit(sorted({0, *bounds})), F.col("slot"), ranges)
    first = saved(slim.groupBy("source", part.alias("part")).agg(F.min(F.struct("rank", *ORDER, "alike")).alias("first")), "begins")
    if first.count() > MOST_CUTS or not first.where("first.alike").isEmpty():
        return None
    by_rank = F.sort_array(F.collect_list(F.struct("first.rank", "part", F.struct(*(F.col(f"first.{c}").alias(c) for c in ORDER)).alias("key"))))
    return first.groupBy("source").agg(by_rank.alias("a")).select("source", F.col("a.key").alias("keys"), F.col("a.part").alias("parts"), F.col("a.rank").alias("ranks"))


def found(values: Column, own: Column, most: int) -> Column:
    """The place of the last of up to ``most`` + 1 ascending values that is not above ``own``, by halving; the first is not."""
    steps = F.lit([1 << i for i in range(most.bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(values, at + step) <= own, F.lit(False)), step).otherwise(0))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (doc_id, source, ...) with PLACE: block of its source, seat in it, slot, and the block's release
    and deadline in slots. ``orderBy("slot", "seat")`` is the mixed order."""
    docs = docs.drop(*PLACE)
    return placed(docs, weights, block_rows).select(*(F.col("row")[c].alias(c) for c in docs.columns), *PLACE)


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, the table's files and rows in mixed order (ranges of slots)."""
    schedule, ranges = Schedule(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = begins(schedule, docs, ranges) if schedule.sent else None
    if cuts is None:
        out = placed(docs).orderBy("slot", "seat")
    else:
        at = found(F.col("keys"), F.struct(*ORDER), ranges)
        dealt = keyed(docs).join(F.broadcast(cuts), "source").withColumn("at", at).withColumns({"part": F.get("parts", "at"), "start": F.get("ranks", "at")})
        dealt = dealt.select("row", "source", *ORDER, "part", "start").repartitionByRange("part")
        # The ranges hold whole parts, so the rows aren't shuffled again.
        within = F.row_number().over(Window.partitionBy("part", "source").orderBy(*ORDER)) - 1
        out = schedule.of(dealt.withColumn("rank", F.col("start") + within)).sortWithinPartitions("slot", "seat")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, ('0x' || substr(md5(doc_id::varchar), 1, 3))::bigint AS bucket FROM documents
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY bucket, doc_id) - 1 AS place FROM d
), n AS (
  SELECT source, sqrt(count(*)) AS w FROM documents GROUP BY source
), q AS (
  SELECT source, greatest(1, floor(greatest({SHARES}, {SOURCE_SHARES} * (SELECT count(*) FROM n)) * w / (SELECT sum(w) FROM n) + 0.5))::bigint AS share FROM n
), s AS (
  SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS shares, sum(share)::bigint AS whole FROM q
), run(slot, done, pick) AS (
  SELECT -1::bigint, list_transform(shares, lambda x: 0::bigint), 0::bigint FROM s
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p
  FROM (
    SELECT run.slot, run.done, list_min(list_transform(range(1, len(shares) + 1), lambda i: CASE
        WHEN done[i] < shares[i] AND (done[i] * whole) // shares[i] <= run.slot + 1
        THEN (((done[i] + 1) * whole + shares[i] - 1) // shares[i]) * 100000 + i END)) % 100000 AS p
    FROM run, s WHERE run.slot + 1 < whole
  )
), plan AS (
  SELECT slot, s.names[pick] AS source, done[pick] - 1 AS turn FROM run, s WHERE slot >= 0
), b AS (
  SELECT doc_id, r.source, place // {BLOCK_ROWS} AS block, place % {BLOCK_ROWS} AS seat, share, whole
  FROM r JOIN q USING (source), s
)
SELECT b.doc_id, b.source, b.block, b.seat, (b.block // share) * whole + plan.slot AS slot,
  (b.block * whole) // share AS release, ((b.block + 1) * whole + share - 1) // share AS deadline
FROM b JOIN plan ON plan.source = b.source AND plan.turn = b.block % share
"""
