"""Content-addressed vectors: each distinct text is embedded once for a model, whatever files, collections and runs it comes from.

The table ``vectors`` of a store is keyed by (model, digest of the text that is sent). Digests that it lacks are found by an anti-join;
only their texts are fetched, one for each, dealt out by digest and sent in batches. A batch that is done is written to a spool of its
own at once, under the name of its digests, so a task or a run that is lost pays for its last batch only. A batch that fails is
halved until the bad text is found; that one gets no vector and an error, and is tried again by the next run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semindex.functions import constants as K
from semindex.operators.embedding import Embedder, prepared, with_retries
from semindex.sources.commits import Conflict, Store
from semindex.sources.corpus import file_system
from semindex.sources.shared import saved

VECTORS = "collection_id string, digest string, vector array<float>"
SPOOL = pa.schema([("digest", pa.string()), ("vector", pa.list_(pa.float32()))])


@dataclass(frozen=True)
class Embedded:
    """The rows with ``vector``; how many texts were sent for; (digest, error) of texts that no vector was made of."""

    rows: DataFrame
    sent: int
    failed: DataFrame


def in_halves(texts: list[str], embedder: Embedder, tries: int, first_ms: int) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(place, vector, error) of each text; a batch that fails for good is tried by halves."""
    stack = [list(range(len(texts)))]
    while stack:
        some = stack.pop()
        try:
            vectors = with_retries(lambda some=some: embedder([texts[i] for i in some]), tries, first_ms)
            yield from ((i, v, None) for i, v in zip(some, vectors, strict=True))
        except Exception as e:  # noqa: BLE001  any failure of the service
            if len(some) == 1:
                yield some[0], None, f"{type(e).__name__}: {e}"[:500]
            else:
                stack += [some[len(some) // 2 :], some[: len(some) // 2]]


def paid_once(fs: pafs.FileSystem, folder: str, some: list[tuple[str, str]], embedder: Embedder, tries: int, first_ms: int) -> pa.RecordBatch:
    """(digest, vector, error) of a batch of (digest, text): what the spool has of this batch is taken from there, the rest is sent and spooled."""
    digests = [d for d, _ in some]
    name = f"{folder}/{hashlib.sha256(''.join(digests).encode()).hexdigest()}.parquet"
    known: dict[str, list[float]] = {}
    if fs.get_file_info(name).type == pafs.FileType.File:  # an earlier attempt of this task has paid for it
        rows = pq.read_table(name, filesystem=fs).to_pydict()
        known = dict(zip(rows["digest"], rows["vector"], strict=True))
    wanted = [i for i, d in enumerate(digests) if d not in known]
    made: list = [known.get(d) for d in digests]
    errors: list = [None] * len(some)
    for i, v, e in in_halves([some[i][1] for i in wanted], embedder, tries, first_ms) if wanted else ():
        made[wanted[i]], errors[wanted[i]] = v, e
    good = [i for i, e in enumerate(errors) if e is None]
    if wanted:
        whole = pa.table([pa.array([digests[i] for i in good], pa.string()), pa.array([made[i] for i in good], pa.list_(pa.float32()))], schema=SPOOL)
        part = f"{name}.{uuid.uuid4().hex}"  # attempts side by side don't write to one file
        pq.write_table(whole, part, filesystem=fs)
        fs.move(part, name)
    return pa.RecordBatch.from_arrays([pa.array(digests), pa.array(made, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["digest", "vector", "error"])


def embed_once(
    df: DataFrame, text_col: str, embedder: Embedder, store: Store, model: str, prefix: str | None = None, batch_size: int = K.BATCH_BLOCKS,
    tries: int = K.RETRIES, first_ms: int = K.RETRY_MS, partitions: int | None = None,
) -> Embedded:
    """df with ``vector``, as embed() makes it, by way of the store's vectors of ``model``; new ones are committed to it."""
    spark = df.sparkSession
    text = prepared(text_col, prefix)
    rows = df.drop("vector").withColumn("_text", text).withColumn("_digest", F.sha2(F.col("_text").cast("binary"), 256))
    spool = f"spool/{hashlib.sha256(model.encode()).hexdigest()[:32]}"
    own = f"{store.root}/{spool}/{uuid.uuid4().hex}"
    state = store.state()
    known = store.read("vectors", [model], state)
    known = known.select("digest", "vector") if known is not None else spark.createDataFrame([], "digest string, vector array<float>")
    left = [f"{store.root}/{name}" for name, _ in store.files.below(spool) if name.endswith(".parquet")]
    if left:  # what an earlier run has paid for and not committed
        known = known.unionByName(spark.read.schema("digest string, vector array<float>").parquet(*left)).dropDuplicates(["digest"])
    needed = rows.where("_text IS NOT NULL").select("_digest").distinct().join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti")
    texts = rows.select("_digest", "_text").join(saved(needed, "needed"), "_digest").dropDuplicates(["_digest"])
    dealt = texts.repartition(partitions, "_digest") if partitions else texts.repartition("_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(own)
        fs.create_dir(folder, recursive=True)
        held: list[tuple[str, str]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= batch_size:
                yield paid_once(fs, folder, held[:batch_size], embedder, tries, first_ms)
                held = held[batch_size:]
        if held:
            yield paid_once(fs, folder, held, embedder, tries, first_ms)

    made = saved(dealt.sortWithinPartitions("_digest").mapInArrow(run, "digest string, vector array<float>, error string"), "made")
    fresh = made.where("error IS NULL").select("digest", "vector")
    both = known.unionByName(fresh)
    while True:
        held = store.read("vectors", [model], state)
        new = both if held is None else both.join(held.select("digest"), "digest", "left_anti")
        try:
            store.append(new.withColumn("collection_id", F.lit(model)), "vectors", "digest", state)
            break
        except Conflict:  # another run has added vectors of this model: ours go beside them
            state = store.state()
    for name in [x[len(store.root) + 1 :] for x in left]:
        store.files.delete(name)
    store.files.delete_folder(own[len(store.root) + 1 :])  # a file for each batch: too many to delete one by one
    vectors = store.read("vectors", [model]).select(F.col("digest").alias("_digest"), "vector")
    return Embedded(rows.join(vectors, "_digest", "left").drop("_digest", "_text"), made.count(), made.where("error IS NOT NULL").select("digest", "error"))
