"""A streaming source of what changes in worktrees: rows of changed and deleted files.

    spark.dataSource.register(WorktreeChanges)
    stream = spark.readStream.format("worktree_changes").option("path", root).option("state", folder).load()

Each folder below ``path`` is a worktree. An offset is the number of a listing (path, size, time of the last change) that lies in
``state``; the source compares two listings and reads the files that differ, in partitions of FILES paths, next to the executors.
A deleted file, or one that has gone when it is read, has null content. Listing is the driver's work, a line for each file; contents
never pass it. Offsets that Spark has committed make older listings needless, and they are removed.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter

from semindex.functions import constants as K
from semindex.jobs.index import apply_changes
from semindex.operators.embedding import Embedder
from semindex.sources.commits import Store

CHANGES = "worktree string, collection_id string, file_path string, resolved_path string, size_bytes long, content string"
FILES = 200


@dataclass
class Paths(InputPartition):
    changed: list[str]
    deleted: list[str]


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.most = int(options.get("max_bytes", K.MAX_FILE_BYTES))
        os.makedirs(self.state, exist_ok=True)

    # -- listings

    def listing(self) -> dict[str, list[int]]:
        out = {}
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(f for f in folders if f not in K.IGNORED_DIRS)
            for name in names:
                path = os.path.join(folder, name)
                if os.path.splitext(name)[1].lower() in K.EXTENSIONS and os.path.dirname(os.path.relpath(path, self.root)):
                    try:
                        found = os.stat(path)
                    except FileNotFoundError:
                        continue
                    out[os.path.relpath(path, self.root)] = [found.st_size, found.st_mtime_ns]
        return out

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(self.state) if n.endswith(".json") and n[:-5].isdigit())

    def stored(self, n: int) -> dict[str, list[int]]:
        if not n:
            return {}
        with open(f"{self.state}/{n}.json") as f:
            return json.load(f)

    # -- the reader

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        now, n = self.listing(), max(self.numbers(), default=0)
        if now != self.stored(n):
            n += 1
            own = f"{self.state}/.{uuid.uuid4().hex}"
            with open(own, "w") as f:
                json.dump(now, f)
            os.rename(own, f"{self.state}/{n}.json")
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = self.stored(start["listing"]), self.stored(end["listing"])
        changed, deleted = sorted(p for p in now if before.get(p) != now[p]), sorted(before.keys() - now.keys())
        cut = lambda x: [x[i : i + FILES] for i in range(0, len(x), FILES)]
        return [Paths(c, []) for c in cut(changed)] + [Paths([], d) for d in cut(deleted)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import hashlib

        for path in [*partition.changed, *partition.deleted]:
            tree, below = path.split("/", 1)
            worktree, resolved, content = f"{self.root}/{tree}", f"{self.root}/{path}", None
            if path in partition.changed:
                try:
                    with open(resolved, "rb") as f:
                        content = f.read(self.most + 1).decode("utf-8", "replace")
                except FileNotFoundError:
                    content = None
            size = os.path.getsize(resolved) if content is not None and os.path.exists(resolved) else 0
            yield worktree, f"ws-{hashlib.sha256(worktree.encode()).hexdigest()[:16]}", below, resolved, size, content

    def commit(self, end: dict) -> None:
        for n in self.numbers():
            if n < end["listing"]:
                os.remove(f"{self.state}/{n}.json")


class WorktreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worktree_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self.options)


def ingest(changes: DataFrame, store: str, embedder: Embedder, dim: int, checkpoint: str, source: str = "stream", at: str = "1970-01-01", max_bytes: int = K.MAX_FILE_BYTES) -> DataStreamWriter:
    """Streams changes of files into a store: each micro-batch touches the buckets of its own paths only, and is entered into the store in
    the same commit that it makes, so a batch that is replayed after a crash changes nothing."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        apply_changes(spark, batch.drop("worktree"), Store(spark, store), embedder, dim, f"{source}-{n}", at, max_bytes)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
