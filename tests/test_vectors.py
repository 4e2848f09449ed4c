"""Content-addressed vectors."""

import os
import uuid

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from semindex.jobs.index import run_index
from semindex.operators import chunking, embedding, vectors
from semindex.sources.commits import Store
from tests.test_index import worktrees


def counting(folder, poison=None, dies_at=None):
    """An embedder that writes down what it is sent; fails on a text, or ends its worker at one if it is asked for the first time."""

    def run(texts):
        if poison and any(poison in t for t in texts):
            raise ValueError("bad text")
        if dies_at and any(dies_at in t for t in texts) and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return np.array([[len(t), 1, 2] for t in texts], np.float32)

    return run


def sent(folder):
    return [line for name in os.listdir(folder) if name != "died" for line in open(f"{folder}/{name}").read().split("\n")]


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")


def test_equal_texts_are_sent_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store, e = Store(spark, str(tmp_path / "store")), counting(str(calls))
    texts = [f"text {i % 20}" for i in range(60)] + [None, " ", "text 3  "]
    done = vectors.embed_once(table(spark, texts), "t", e, store, "m", batch_size=3, partitions=2)
    rows = {r.i: r.vector for r in done.rows.collect()}
    assert done.sent == 20 and sorted(sent(calls)) == sorted(f"text {i}" for i in range(20)) and done.failed.count() == 0
    assert len(rows) == 63 and rows[60] is None and rows[61] is None and rows[62] == rows[3] == [6.0, 1.0, 2.0]
    again = vectors.embed_once(table(spark, ["text 1", "new", "text 2"]), "t", e, store, "m")
    assert again.sent == 1 and all(r.vector for r in again.rows.collect())
    other = vectors.embed_once(table(spark, ["text 1"]), "t", e, store, "other model")
    assert other.sent == 1 and store.read("vectors").count() == 22 and not [n for n, _ in store.files.below("spool")]


def test_a_bad_text_costs_no_other(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    texts = [f"text {i}" for i in range(30)] + ["poison"]
    done = vectors.embed_once(table(spark, texts), "t", counting(str(calls), poison="poison"), store, "m", batch_size=8, tries=1)
    assert {r.t for r in done.rows.where("vector IS NULL").collect()} == {"poison"}
    assert [r.error for r in done.failed.collect()] == ["ValueError: bad text"] and sorted(sent(calls)) == sorted(texts[:-1])
    after = vectors.embed_once(table(spark, texts), "t", counting(str(calls)), store, "m")
    assert after.sent == 1 and after.rows.where("vector IS NULL").count() == 0


def test_a_lost_run_pays_for_one_batch(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    texts = [f"text {i}" for i in range(40)]
    e = counting(str(calls), dies_at="text 17")
    with pytest.raises(Exception):  # noqa: B017  the worker is gone
        vectors.embed_once(table(spark, texts), "t", e, store, "m", batch_size=4, partitions=1)
    before = len(sent(calls))
    done = vectors.embed_once(table(spark, texts), "t", e, store, "m", batch_size=4, partitions=1)
    assert done.rows.where("vector IS NULL").count() == 0 and sorted(sent(calls)) == sorted(texts) and done.sent == 40 - before


def test_a_task_that_is_tried_again_pays_once(tmp_path):
    calls = []

    def e(texts):
        calls.append(list(texts))
        if "bad" in texts:
            raise ValueError("bad text")
        return np.array([[len(t)] for t in texts], np.float32)

    some = [("d1", "one"), ("d2", "bad"), ("d3", "three")]
    fs = pafs.LocalFileSystem()
    first = vectors.paid_once(fs, str(tmp_path), some, e, 1, 0).to_pydict()
    assert first["vector"] == [[3.0], None, [5.0]] and first["error"][1] == "ValueError: bad text"
    calls.clear()
    again = vectors.paid_once(fs, str(tmp_path), some, e, 1, 0).to_pydict()
    assert again == first and calls == [["bad"]] and len(os.listdir(tmp_path)) == 1


def test_two_runs_add_vectors_of_one_model(spark, tmp_path):
    root = str(tmp_path / "store")
    calls = tmp_path / "calls"
    calls.mkdir()
    e = counting(str(calls))

    class Slow(Store):
        tried = 0

        def append(self, *args):
            self.tried += 1
            if self.tried == 1:
                vectors.embed_once(table(spark, ["a", "b"]), "t", e, Store(spark, root), "m")
            return super().append(*args)

    store = Slow(spark, root)
    done = vectors.embed_once(table(spark, ["b", "c"]), "t", e, store, "m")
    assert store.tried == 2 and done.rows.where("vector IS NULL").count() == 0
    assert sorted(r.digest for r in store.read("vectors").collect()) == sorted({r.digest for r in store.read("vectors").collect()}) and store.read("vectors").count() == 3


def test_runs_share_vectors(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    e, root = counting(str(calls)), str(tmp_path / "store")
    store = Store(spark, root)
    files = worktrees(spark, 6, ["ws-1"])
    run_index(spark, files, store, e, 3, "r1", "2024-01-01", vectors=(store, "m"))
    copy = files.withColumn("collection_id", F.lit("ws-2"))
    run_index(spark, copy, store, e, 3, "r2", "2024-01-02", vectors=(store, "m"))
    points = store.read("points").groupBy("collection_id").count().collect()
    assert {(r.collection_id, r["count"]) for r in points} == {("ws-1", 6), ("ws-2", 6)} and len({t for t in sent(calls) if t}) <= 12
    assert sum(1 for n in os.listdir(calls)) >= 1 and store.read("vectors").count() == 6


def test_files_of_vectors_hold_thousands_of_rows(spark, tmp_path):
    """A bucket of the vectors' table is a file: 2,000 texts make one, not eight; and the run's spool is gone as a whole."""
    store = Store(spark, f"file://{tmp_path}/s")
    done = vectors.embed_once(table(spark, [f"text {i}" for i in range(2000)]), "t", lambda texts: np.ones((len(texts), 4), np.float32), store, "m")
    assert done.sent == 2000 and done.rows.where("vector IS NOT NULL").count() == 2000
    assert sum(len(p.files) for p in store.state().of("vectors").values()) == 1
    assert not [n for n, _ in store.files.below("spool")]


def test_batches_for_python_are_bounded(spark):
    """What embeds and chunks asks Spark for batches of a thousand rows and 16 MB at most, whatever a table's size."""
    df = spark.createDataFrame([("c", "f", "a b")], "collection_id string, file_path string, content string")
    for make in (lambda: embedding.embed(df, "content", embedding.hashing_embedder(4)), lambda: chunking.chunk_lines(df)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        make()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "16m"
