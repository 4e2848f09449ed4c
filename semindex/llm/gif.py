"""Media columns: GIF.

``encode_texts`` stores bytes as GIF pixels: 64 samples a row, a frame for every 1024 rows, the grey ramp
as palette, LZW-packed. ``decode_frames`` reads any GIF column: code streams of any code size with clears
wherever an encoder puts them (or never), local and global palettes, interlacing, transparency and the four disposal methods;
it returns a row per frame with times, rectangle, composed RGBA pixels and colour histograms. Rows of one
image are in frame order, and each carries what the samples up to it add up to (bytes, SHA-256, last 64
bytes, histogram), so the last frame's row describes the whole image and nothing is shuffled. Work and
memory are those of one image at a time, whose frames are small.

LZW widths depend only on how many codes came since the last clear, so bits are packed and unpacked by
numpy for whole runs of codes; only the dictionary steps are a loop.

Defined cases: a null text counts as empty; payloads are padded with bytes 0 to a positive multiple of 64,
so an empty text has one row of zeros; a null medium gives no frames; equal texts give equal media and
equal rows; other columns are ignored, except those named in ``keep``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semindex.llm.common import map_batches, table

ROW, FRAME_ROWS, TOP = 64, 1024, 4096
MEDIA = "doc_id long, n_bytes long, media binary"
FRAMES = (
    "frame_no long, delay_ms long, start_ms long, x int, y int, width int, height int, disposal int, transparent int, "
    "histogram array<long>, pixels binary, samples_so_far long, samples_sha256_so_far string, tail binary, histogram_so_far array<long>, is_last boolean"
)


def code_widths(size: int) -> np.ndarray:
    """Bits of the k-th code after a clear, for ``size``-bit samples."""
    k = np.arange(TOP)
    entry = np.maximum((1 << size) + 1 + k, (1 << (size + 1)) - 1)
    return np.minimum(np.floor(np.log2(entry)).astype(np.int64) + 1, 12)


WIDTHS = {size: code_widths(size) for size in range(2, 9)}
ENDS = {size: np.cumsum(w) for size, w in WIDTHS.items()}


SINGLE = [b << 8 for b in range(256)]


def lzw_pack(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples. Codes are kept times 256, so code and next byte add up to a key."""
    clear, end, new_first, new_top = 256 << 8, 257 << 8, 258 << 8, TOP << 8
    codes, marks = [clear], [0]  # marks: where each clear stands
    held: dict[int, int] = {}
    get, put, single = held.get, codes.append, SINGLE
    new, w = new_first, single[data[0]]
    for b in data[1:]:
        c = get(w + b)
        if c:
            w = c
            continue
        put(w)
        held[w + b] = new
        w = single[b]
        new += 256
        if new == new_top:
            marks.append(len(codes))
            put(clear)
            held.clear()
            new = new_first
    put(w)
    put(end)
    widths = np.full(len(codes), 9, np.int64)
    for a, b in zip(marks, [*marks[1:], len(codes) - 1], strict=True):
        widths[a + 1 : b + 1] = WIDTHS[8][: b - a]
    values = np.array(codes, np.int32) >> 8
    bits = (values[:, None] >> np.arange(12, dtype=np.int32)) & 1
    return np.packbits(bits.astype(bool)[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def spelt(codes: np.ndarray, clear: int) -> bytes:
    """What the codes between two clears stand for.

    Code clear+2+j means the j-th code's string and the byte after it in the output, so every output byte
    is a literal or a copy of an earlier one; both lengths and bytes follow by pointer doubling.
    """
    n = len(codes)
    above = np.arange(n)
    if (codes >= clear + 2 + above).any():
        raise ValueError("code outside the table")
    literal = codes < clear
    up = np.where(literal, above, codes - (clear + 2))
    length = np.where(literal, 0, 1)
    while (hop := length[up]).any():
        length = length + hop
        up = up[up]
    length += 1
    begin = np.cumsum(length) - length
    owner = np.repeat(above, length)
    source = np.arange(len(owner))
    source = np.where(literal[owner], source, source - begin[owner] + begin[np.maximum(codes - (clear + 2), 0)][owner])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[owner[source]].astype(np.uint8).tobytes()


def lzw_unpack(stream: bytes, size: int, n: int) -> bytes:
    """n samples of a code stream, or fewer if it ends early."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, got = 8 * len(stream), 0, 0
    out: list[bytes] = []
    run: list[np.ndarray] = []  # codes since the last clear
    while got < n:
        ends = at + (np.arange(1, TOP + 1) * 12 if run else ENDS[size])
        ends = ends[: int(np.searchsorted(ends, total, "right"))]
        starts = np.concatenate(([at], ends[:-1])) if len(ends) else ends
        byte = starts >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7) & (1 << (ends - starts)) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))
        run.append(codes[: int(stop[0])] if len(stop) else codes)
        if len(codes) and not len(stop):  # the table is full and no clear has come: the next codes have 12 bits
            at = int(ends[-1])
            continue
        whole = np.concatenate(run)
        if len(whole):
            out.append(spelt(whole, clear))
            got += len(out[-1])
        if not len(codes) or codes[stop[0]] == end:
            break
        at, run = int(ends[stop[0]]), []
    return b"".join(out)[:n]


def blocks(data: bytes) -> bytes:
    """Data as sub-blocks with their terminator."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def pack_gif(payload: bytes, delay_cs: int = 4) -> bytes:
    """A payload of whole rows as an animated grey GIF."""
    rows = len(payload) // ROW
    ramp = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), ramp]
    for a in range(0, rows, FRAME_ROWS):
        part = payload[a * ROW : (a + FRAME_ROWS) * ROW]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, ROW, len(part) // ROW, 0, 8))
        out.append(blocks(lzw_pack(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    no: int
    delay_ms: int
    start_ms: int
    x: int
    y: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  # palette indices, height x width
    palette: np.ndarray  # 256 x 3
    canvas: np.ndarray  # RGBA after this frame is drawn, before its disposal


def deinterlaced(rows: np.ndarray) -> np.ndarray:
    out = np.empty_like(rows)
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, len(rows), step)]
    out[order] = rows
    return out


def frames_of(gif: bytes) -> Iterator[Frame]:
    """The frames in order. A missing palette is the grey ramp; pixels that nothing has drawn are transparent."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", gif, 6)
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        out = np.zeros((256, 3), np.uint8)
        out[:n] = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return out

    def data() -> bytes:
        nonlocal at
        parts = []
        while n := gif[at]:
            parts.append(gif[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common = colours(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    control, no, clock = (0, 0, None), 0, 0
    while at < len(gif) and gif[at] != 0x3B:
        kind = gif[at]
        if kind == 0x21:
            label = gif[at + 1]
            at += 2
            body = data()
            if label == 0xF9:
                control = (body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0] * 10, body[3] if body[0] & 1 else None)
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        x, y, w, h, own = struct.unpack_from("<HHHHB", gif, at + 1)
        at += 10
        palette = colours(own)
        palette = palette if palette is not None else common if common is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        size = gif[at]
        at += 1
        flat = np.frombuffer(lzw_unpack(data(), size, w * h), np.uint8)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(flat)] = flat
        samples = samples.reshape(h, w)
        samples = deinterlaced(samples) if own & 0x40 else samples
        disposal, delay, clear = control
        before = canvas.copy() if disposal == 3 else None
        seen_h, seen_w = max(0, min(h, height - y)), max(0, min(w, width - x))
        area, drawn = canvas[y : y + seen_h, x : x + seen_w], samples[:seen_h, :seen_w]
        opaque = np.ones(drawn.shape, bool) if clear is None else drawn != clear
        area[opaque, :3] = palette[drawn[opaque]]
        area[opaque, 3] = 255
        yield Frame(no, delay, clock, x, y, w, h, disposal, clear, samples, palette, canvas)
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        no, clock, control = no + 1, clock + delay, (0, 0, None)


def histogram(frame: Frame) -> np.ndarray:
    """Pixels the frame draws, by 16 levels of red, then of green, then of blue."""
    counts = np.bincount(frame.samples.ravel(), minlength=256)
    if frame.transparent is not None:
        counts[frame.transparent] = 0
    return np.concatenate([np.bincount(frame.palette[:, c] >> 4, counts, 16) for c in range(3)]).astype(np.int64)


def encode_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with their UTF-8 bytes as a GIF: MEDIA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [pack_gif(r + bytes(-len(r) % ROW if r else ROW)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, MEDIA)


def decode_frames(media: DataFrame, keep: list[str], pixels: bool = True) -> DataFrame:
    """A row per frame of the column ``media``: the columns ``keep`` and FRAMES. ``pixels=False`` leaves the pixels null."""
    made = T.StructType.fromDDL(FRAMES)
    schema = T.StructType([*media.select(*keep).schema.fields, *made.fields])
    kinds = [pa.int64()] * 3 + [pa.int32()] * 6 + [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]

    def rows_of(gif: bytes) -> list[tuple]:
        sha, n, tail, sums, out = hashlib.sha256(), 0, b"", np.zeros(48, np.int64), []
        for f in frames_of(gif):
            flat = f.samples.tobytes()
            sha.update(flat)
            n, tail, own = n + len(flat), (tail + flat)[-64:], histogram(f)
            sums = sums + own
            rgba = f.canvas[f.y : f.y + f.height, f.x : f.x + f.width].tobytes() if pixels else None
            out.append((f.no, f.delay_ms, f.start_ms, f.x, f.y, f.width, f.height, f.disposal, f.transparent, own.tolist(), rgba, n, sha.hexdigest(), tail, sums.tolist()))
        return [(*r, i == len(out) - 1) for i, r in enumerate(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [rows_of(g) if g is not None else [] for g in part.column(len(keep)).to_pylist()]
                owners = pa.array([k for k, r in enumerate(found) for _ in r], pa.int64())
                columns = list(zip(*(x for r in found for x in r), strict=True)) or [()] * len(kinds)
                kept = [part.column(k).take(owners) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keep, *made.names])

    return map_batches(media.select(*keep, "media"), run, schema)


def op9_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = encode_texts(table(spark, sf_dir, "documents"))
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    last = decode_frames(media, ["doc_id", "n_bytes", "media_bytes", "media_sha256"], pixels=False).where("is_last")
    feature = F.concat(F.lit("frames="), F.col("frame_no") + 1, F.lit(";ms="), F.col("start_ms") + F.col("delay_ms"), F.lit(";levels="), F.array_join(F.slice("histogram_so_far", 1, 16).cast("array<string>"), ","))
    return last.select(
        "doc_id", "n_bytes", F.col("samples_so_far").alias("payload_bytes"), F.col("samples_sha256_so_far").alias("payload_sha256"),
        F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )
