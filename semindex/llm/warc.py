"""WARC archives as a chunked record table.

Writing: each task streams its pages into one ``.warc.gz`` file (a gzip member a record) in a shared
folder, under a name of its own attempt; Spark writes the list of files, so what a lost attempt left is
never read. Equal payloads of at least ``least_bytes`` become one response and revisits that name it.

Reading: an archive is a stream. Its members are inflated piece by piece and every record comes out as
rows (record id, chunk number, at most ``chunk_bytes`` of payload, bytes and SHA-256 up to and with this
chunk), so no record is ever whole in memory and the last chunk's row carries the record's size and
digest without a shuffle. Within one task the chunks of a record are in order.

Which payload is the response: the smallest page_id of each (digest, length), found by a partial
aggregation, so a payload that many pages share sends one row a task. The answer joins slim rows (page_id,
digest), which Spark may split where one digest is hot; payloads are never dealt out by digest, but meet
the revisits by page.

Defined cases: null html is an empty payload; empty and short payloads are responses; a null page_id is
written as an empty record id part, read back as null, always a response and never referred to; rows that repeat a
page_id and payload are all written: one that carries the smallest page_id is a response, each of them;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import map_batches, shared_folder, table

ARCHIVES = "path string, n_records long, n_bytes long"
CHUNKS = (
    "page_id long, record_id string, record_type string, target_uri string, refers_to long, chunk_no long, "
    "data binary, bytes_so_far long, digest_so_far string, header_digest string, is_last boolean"
)
READ_BYTES = 1 << 16


def plan_records(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages (page_id, url, html) with payload digest, record type and the response's page_id."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    full = full.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    slim = full.where((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest", "n_bytes")
    firsts = slim.groupBy("digest", "n_bytes").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id <> last_id")
    # Slim rows meet by digest; payloads then meet the revisits by page, so copies of one payload are dealt out like any other rows.
    revisits = slim.join(firsts.select("digest", "n_bytes", "first_id"), ["digest", "n_bytes"]).where("page_id <> first_id").select("page_id", "digest", "first_id").distinct()
    revisit = F.col("first_id").isNotNull()
    return full.join(revisits, ["page_id", "digest"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.col("first_id").alias("refers_to")
    )


def header(page_id: int | None, url: str | None, kind: str, digest: str, refers_to: int | None, n: int) -> bytes:
    """A record's header; a revisit holds no payload but keeps its digest and length in the header."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Payload-Length: {n}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else n}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes planned records; returns the table of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            ids, urls, payloads, digests, kinds, refers = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                kind, body = kinds[i].as_py(), memoryview(payloads[i].as_buffer())
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                parts = [pack.compress(header(ids[i].as_py(), urls[i].as_py(), kind, digests[i].as_py(), refers[i].as_py(), len(body)))]
                if kind != "revisit":
                    parts += [pack.compress(body[j : j + READ_BYTES]) for j in range(0, len(body), READ_BYTES)]
                parts += [pack.compress(b"\r\n\r\n"), pack.flush()]
                for part in parts:
                    out.write(part)
                    size += len(part)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([size])], ["path", "n_records", "n_bytes"])

    map_batches(records, run, ARCHIVES).write.parquet(f"{folder}/archives")
    return records.sparkSession.read.parquet(f"{folder}/archives")


class MemberReader:
    """Reads a gzip-member stream as one byte stream, holding no more than a piece of it."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.z, self.raw, self.held = stream, zlib.decompressobj(31), b"", b""
        self.within = False  # a member that has begun and not ended

    def more(self) -> bool:
        """Inflates the next piece into ``held``; false at the end, which is the end of a member, checksum included."""
        while True:
            raw = self.raw or self.stream.read(READ_BYTES)
            if not raw:
                if self.within:
                    raise EOFError("archive ends within a member")
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(raw, READ_BYTES)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.within = not self.z.eof
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held:
                    raise EOFError("archive ends within a header")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, as pieces."""
        while n:
            if not self.held and not self.more():
                raise EOFError("archive ends within a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}


def chunks_of(stream: pa.NativeFile, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of CHUNKS. A record without payload gives one empty chunk; a revisit's row has its header's length and digest."""
    read = MemberReader(stream)
    number = lambda name: int(x) if name and (x := name[len("<urn:page:") : -1]) else None
    while (block := read.until(b"\r\n\r\n")) is not None:
        h = parse_header(block)
        name, kind, told = h["warc-record-id"], h["warc-type"], h["warc-payload-digest"].rpartition(":")[2]
        fixed = (number(name), name, kind, h.get("warc-target-uri"), number(h.get("warc-refers-to")))
        n = int(h["content-length"])
        sha, done, no, held = hashlib.sha256(), 0, 0, b""
        for piece in read.take(n):
            held += piece
            while len(held) >= chunk_bytes or held and done + len(held) == n:
                chunk, held = held[:chunk_bytes], held[chunk_bytes:]
                sha.update(chunk)
                done += len(chunk)
                yield (*fixed, no, chunk, done, sha.hexdigest(), told, done == n)
                no += 1
        if not n:
            size = int(h.get("x-payload-length", 0))
            yield (*fixed, 0, b"", size, told if kind == "revisit" else sha.hexdigest(), told, True)
        if b"".join(read.take(4)) != b"\r\n\r\n":
            raise ValueError(f"record {name} doesn't end where its length says")


def read_chunks(archives: DataFrame, chunk_bytes: int = 1 << 18, with_data: bool = True) -> DataFrame:
    """The chunked record table (CHUNKS) of the archives; one task takes whole archives, one after the other.
    An archive that is cut, between records too, raises EOFError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        names = [c.split()[0] for c in CHUNKS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for paths in batches:
            for path, n_records in zip(paths.column(0).to_pylist(), paths.column(1).to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(name) as stream:
                    for row in chunks_of(stream, chunk_bytes):
                        n_records -= row[-1]
                        rows.append(row if with_data else (*row[:6], None, *row[7:]))
                        size += len(row[6]) + 300
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if n_records:
                    raise EOFError(f"{path} lacks {n_records} records")
                if rows:
                    yield batch(rows)

    n = max(1, archives.count())
    return map_batches(archives.select("path", "n_records").repartition(n, "path"), run, CHUNKS)


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(plan_records(table(spark, sf_dir, "pages"), 100), shared_folder(spark, "warc"))
    return read_chunks(archives).where("is_last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
