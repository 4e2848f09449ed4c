"""Quality rules by compression bands.

A text whose zstandard ratio (raw bytes / compressed bytes) is too high for its length repeats itself;
one whose ratio is too low is noise (base64, hashes, ciphertext). Short texts compress badly whatever
they say and long ones well, so each length class has its own band. Chunks of fixed size are judged
too: a clean page with a long repetitive or random insert has a plain ratio as a whole but too many
chunks outside the chunk band. The last chunk is the text's final bytes and may overlap the one before, so
every byte is judged; a text shorter than a chunk is one chunk, held against the band of its own length.

The limits come from the corpus: a first pass counts the ratios of all texts of 50 words or more by length class
(four to a doubling) and those of all chunks, in bins, so what is gathered is bounded. A class's band is its median,
and the median of its neighbours' medians, so that one group of copies can't move it, give or take WIDE quartile
ranges, and shrunk towards the wide default band as if that were LEAST texts more: the fewer texts a class has, the
wider its band, with no border between few and many. Most of any class has to be clean text.

Defined cases: a null text counts as empty; an empty text has 0 words and ratio 1.0; equal rows get
equal results, as each row is judged alone; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import SPACES, map_batches, table

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long, reason string"
)


@dataclass(frozen=True)
class Bands:
    """Limits by length, as far as none are fitted: (shorter than so many bytes, least ratio, greatest ratio)."""

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 3.0),
        (512, 0.9, 2.6),
        (1024, 1.15, 2.7),
        (4096, 1.35, 2.9),
        (16384, 1.4, 3.2),
        (float("inf"), 1.4, 3.6),
    )
    chunk_bytes: int = 1024
    chunk: tuple[float, float] = (1.35, 2.8)
    bad_share: float = 0.25
    level: int = 3

    fitted: dict[int, tuple[float, float]] = field(default_factory=dict)  # by length_class()

    def limits(self, n_bytes: int) -> tuple[float, float]:
        if (own := self.fitted.get(length_class(n_bytes))) is not None:
            return own
        return next((low, high) for under, low, high in self.whole if n_bytes < under)


def length_class(n_bytes: int) -> int:
    """Four classes to a doubling of the length."""
    return int(math.log2(n_bytes) * 4) if n_bytes > 0 else -1


#: Texts that the default band counts for; quartile ranges from the median to its upper and lower limit, for whole
#: texts and for chunks; the least range, as a share of the median; bins to a ratio of one, and the last bin.
LEAST, WIDE, WIDE_CHUNK, NARROW, BINS, LAST_BIN = 8, (3.0, 4.0), (2.5, 3.5), 0.02, 100, 2000


def chunk_starts(n_bytes: int, size: int) -> list[int]:
    """Where chunks start; the last one ends where the text does."""
    return [min(i, max(0, n_bytes - size)) for i in range(0, n_bytes, size)]


def ratio_counts(docs: DataFrame, bands: Bands) -> DataFrame:
    """docs (text): (kind, class, bin, n), kind 0 for whole texts of 50 words or more, 1 for their chunks of full size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        place = lambda raw: min(LAST_BIN, int(BINS * len(raw) / len(packer.compress(raw))))
        held: Counter[tuple[int, int, int]] = Counter()
        for batch in batches:
            for t in batch.column(0):
                raw = (t.as_py() or "").encode()
                if len(raw.split(None, 49)) < 50:
                    continue
                held[0, length_class(len(raw)), place(raw)] += 1
                if len(raw) >= bands.chunk_bytes:
                    held.update((1, 0, place(raw[i : i + bands.chunk_bytes])) for i in chunk_starts(len(raw), bands.chunk_bytes))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in held], pa.int32()) for i in range(3)] + [pa.array(list(held.values()), pa.int64())], ["kind", "class", "bin", "n"])

    counted = map_batches(docs.select("text"), run, "kind int, class int, bin int, n long")
    return counted.groupBy("kind", "class", "bin").agg(F.sum("n").alias("n"))


def quartiles(counts: dict[int, int]) -> tuple[float, float, float]:
    """25 %, 50 % and 75 % of binned ratios, each as the middle of its bin."""
    bins = sorted(counts)
    upto = np.cumsum([counts[b] for b in bins])
    return tuple((bins[int(np.searchsorted(upto, q * upto[-1]))] + 0.5) / BINS for q in (0.25, 0.5, 0.75))  # type: ignore[return-value]


def weighted_median(values: list[tuple[float, int]]) -> float:
    """Of (value, weight): the middle of the lower and the upper one."""
    values = sorted(values)
    upto, half = np.cumsum([w for _, w in values]), sum(w for _, w in values) / 2
    return (values[int(np.searchsorted(upto, half))][0] + values[int(np.searchsorted(upto, half, side="right"))][0]) / 2


def fitted_bands(docs: DataFrame, bands: Bands | None = None) -> Bands:
    """Bands by length from the ratios of all texts of ``docs`` (text)."""
    bands = bands or Bands()
    counts: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for r in ratio_counts(docs, bands).collect():  # a row for each class and bin: bounded
        counts[r["kind"], r["class"]][r["bin"]] = r["n"]
    seen = {c: quartiles(x) for (kind, c), x in counts.items() if kind == 0}
    sizes = {c: sum(x.values()) for (kind, c), x in counts.items() if kind == 0}

    def band(middle: float, spread: float, wide: tuple[float, float]) -> tuple[float, float]:
        spread = max(spread, NARROW * middle)
        return middle - wide[1] * spread, middle + wide[0] * spread

    def shrunk(own: tuple[float, float], wide: tuple[float, float], n: int) -> tuple[float, float]:
        return tuple((n * a + LEAST * b) / (n + LEAST) for a, b in zip(own, wide, strict=True))  # type: ignore[return-value]

    fitted = {}
    for c in seen:
        near = [c + d for d in (-2, -1, 0, 1, 2) if c + d in seen and c - d in seen]
        own = band(weighted_median([(seen[x][1], min(sizes[x], LEAST)) for x in near]), weighted_median([(seen[x][2] - seen[x][0], min(sizes[x], LEAST)) for x in near]), WIDE)
        fitted[c] = shrunk(own, bands.limits(math.ceil(2 ** (c / 4))), sizes[c])
    chunk = bands.chunk
    if counts[1, 0]:
        low, middle, high = quartiles(counts[1, 0])
        chunk = shrunk(band(middle, high - low, WIDE_CHUNK), bands.chunk, sum(counts[1, 0].values()))
    return replace(bands, fitted=fitted, chunk=chunk)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by a window of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    key = ids[:n]
    for j in range(1, width):  # a pair of numbers under 2**31 fits; ranks keep the next key small
        key = key * (len(seen) + 1) + ids[j : n + j]
        if j < width - 1 and len(seen) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for j in range(width):
        covered[j : n + j] |= twice
    return int(covered.sum())


def judge(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """One row of SCHEMA without its id."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    bare = raw.translate(None, SPACES)
    word_chars = len(text) - (len(raw) - len(bare))
    n_symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    ratio = len(raw) / len(packer.compress(raw)) if raw else 1.0
    low, high = bands.limits(len(raw))
    size = bands.chunk_bytes
    least, most = bands.chunk if len(raw) >= size else (low, high)
    starts = chunk_starts(len(raw), size)
    bad = sum(not least <= len(raw[i : i + size]) / len(packer.compress(raw[i : i + size])) <= most for i in starts)
    reason = (
        "base" if failed else "incompressible" if ratio < low else "repetitive" if ratio > high
        else "chunks" if bad > bands.bad_share * len(starts) else None
    )
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, failed, reason is None, ratio, bad, len(starts), reason


def quality_rules(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base counts, ratios, verdict and its reason (SCHEMA). Without ``bands`` they are
    fitted to ``docs`` first; no text is shuffled."""
    bands = bands or fitted_bands(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [judge(t.as_py(), bands, packer) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * 11
            arrays = [batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def op6_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def kept_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, columns unchanged; rows are judged in place, so nothing is joined."""
    names = docs.columns
    bands = fitted_bands(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        at = names.index("text")
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py(), bands, packer)[6] for t in batch.column(at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
