"""Token ids in flat binary files.

Layout of a folder: per part ``*.ids`` (unsigned little-endian integers, 16 bits if the vocabulary fits,
else 32), ``*.offsets`` (64-bit: where each document starts in the part, and the part's length at the end)
and ``*.docs`` (64-bit document ids); an ``index`` table names the parts that count, in order, with the
number of tokens and documents before each, which are prefix sums over the parts. Parts hold ranges of
doc_id and are sorted, so the files taken in order are the corpus in ascending doc_id order.

A task writes under a name of its own attempt and returns that name as a row; the index is written by
Spark, so files of lost or repeated attempts are never listed. The driver sees one row a part.

Texts are cut before spaces and around line ends, where the tokenizer's pre-tokenizer always starts a token
(texts whose white space runs would break are cut before a space that a non-space follows), so a text's ids
are its pieces' ids in a row. The pieces of an Arrow batch are dictionary-encoded, each distinct one is looked
up once in a bounded memory, and the ids are gathered by numpy. ``exact_cuts`` says when this holds; for other
tokenizers whole texts are encoded.

Defined cases: null text counts as empty (only the end id); a null doc_id is stored as -2**63 and comes
back as null, first in order; repeated rows and equal ids stay separate documents, ordered by text hash;
an empty table gives an index without parts; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import gathered, map_batches, shared_folder, small_batches, table
from semindex.llm.spellings import Memory, distinct, marked_parts, of_each, spans

NULL_ID = -(2**63)
INDEX = "part long, path string, n_docs long, n_tokens long, width int"
#: Bytes of pieces, and most pre-tokens (about 200 bytes each), that a Python worker remembers.
MEMORY, WORDS = 160 << 20, 300_000
CUTS = re.compile(r"(?= \S)")
#: Texts in which white space meets white space in ways that a cut at each space and line end would break.
OTHER_SPACES = r"\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNSAFE = rf"\x00|[ \n]{{3}}|[ \n]{{2}}\z|[{OTHER_SPACES}][ \n]|[ \n][{OTHER_SPACES}]"
ENDS = frozenset(".,;:!?")
#: Characters whose classes are the same in every Unicode version.
PLAIN = re.compile(r"[\n\x20-\x7e\u00c0-\u024f]*\Z")
#: Fixed value: the pre-token pattern of byte-level BPE.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def exact_cuts(tokenizer_json: str) -> bool:
    """True if the tokenizer has no normalizer and splits as byte-level BPE does, without a prefix space."""
    pre = json.loads(tokenizer_json)
    kind = pre.get("pre_tokenizer") or {}
    special = [x for x in pre.get("added_tokens", []) if " " in x["content"] or x.get("lstrip") or x.get("rstrip")]
    plain = [x for x in pre.get("added_tokens", []) if all(c.isalnum() or c in ENDS for c in x["content"])]
    return not plain and not pre.get("normalizer") and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not special


class PieceEncoder:
    """Texts to ids. The distinct pieces of a batch are looked up in a bounded memory; the pre-tokens of new pieces, too;
    a pre-token that is new goes to the tokenizer's model, a piece with unusual characters to the whole tokenizer."""

    def __init__(self, path: str, most_bytes: int = MEMORY, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cut = exact_cuts(self.tok.to_str())
        self.special = [x["content"] for x in json.loads(self.tok.to_str())["added_tokens"]]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.most = words
        self.words: dict[str, bytes] = {}
        self.memory = Memory(self.spelt, self.dtype, 0, most_bytes)

    def fresh(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pretokens: set[str]) -> None:
        """Adds the bytes of the ids of pretokens to ``words``."""
        if len(self.words) + len(pretokens) > self.most:
            self.words = {p: self.words[p] for p in pretokens if p in self.words}
        new = [p for p in pretokens if p not in self.words]
        if not new:
            return
        tokenize = self.model.tokenize
        letters = "\0".join(new).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
        found = [[t.id for t in tokenize(x)] for x in letters]
        raw, size = array(self.code, chain.from_iterable(found)).tobytes(), self.dtype.itemsize
        ends = list(accumulate(map(len, found)))
        self.words.update(zip(new, (raw[a * size : b * size] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def spelt(self, pieces: list[str]) -> list[tuple[bytes]]:
        """The ids of pieces, each as a text of its own."""
        cut: list[tuple[str, ...] | list[str] | None] = []
        for p in pieces:
            bare = p[1:] if p[:1] == " " else p
            if bare.isalpha() and (bare.isascii() or PLAIN.match(bare)):
                cut.append((p,))
            elif bare[:-1].isalpha() and bare[-1] in ENDS and PLAIN.match(bare):
                cut.append((p[:-1], bare[-1]))
            else:
                cut.append(PRETOKENS.findall(p) if PLAIN.match(bare) and not any(x in p for x in self.special) else None)
        self.learn(set(chain.from_iterable(c for c in cut if c)))
        get = self.words.__getitem__
        out = [(get(c[0]) if len(c) == 1 else b"".join(map(get, c)),) if c else (b"",) for c in cut]
        odd = [i for i, c in enumerate(cut) if c is None]
        for a in range(0, len(odd), 4096):
            some = odd[a : a + 4096]
            for i, ids in zip(some, self.fresh([pieces[i] for i in some]), strict=True):
                out[i] = (ids,)
        return out

    def pieces(self, text: str) -> list[str]:
        """Cut before each space that a non-space follows."""
        return CUTS.split(text) if self.cut else [text]

    def of_lists(self, lists: pa.ListArray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are lists of pieces, one after the other, and how many each has."""
        codes, words = distinct(lists.flatten(), plain)
        rows = self.memory.rows(words)[codes]
        ids, sizes = spans(self.memory.flat, self.memory.starts, rows)
        offsets = lists.offsets.to_numpy()
        return ids, of_each(sizes, offsets - offsets[0])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, each with ``end_id`` after it, and how many each has."""
        odd = pc.match_substring_regex(texts, UNSAFE)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        rare = odd.to_numpy(zero_copy_only=False) if self.cut else np.ones(len(texts), bool)
        # The odd are empty in the first list and cut one by one in the second, so each text has its ids from one of them.
        ids, sizes = self.of_lists(marked_parts(pc.if_else(pa.array(rare), "", texts), " "), True)
        if rare.any():
            own, counts = self.of_lists(pa.array([self.pieces(t) for t in texts.filter(pa.array(rare)).to_pylist()], pa.list_(pa.string())), False)
            at = np.cumsum(sizes)[rare]
            ids = np.insert(ids, np.repeat(at, counts), own)
            sizes[rare] = counts
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(sizes), np.array(end_id, self.dtype))
            sizes = sizes + 1
        return ids, sizes

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One for a Python worker, so that tasks which follow each other in it share its caches."""
    return PieceEncoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` to each, writes the files; returns the index."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = encoder(tokenizer)
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out = None
        at = n = 0
        for batch in gathered(batches, 3000, 8 << 20):
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = [fs.open_output_stream(f"{root}/{name}.{kind}") for kind in ("ids", "offsets", "docs")]
            ids, lengths = encode.encode(pc.fill_null(batch.column(1), ""), end_id)
            starts = at + np.concatenate(([0], np.cumsum(lengths)))
            out[0].write(memoryview(ids))
            out[1].write(starts[:-1].astype("<i8").tobytes())
            out[2].write(np.asarray(batch.column(0).fill_null(NULL_ID)).astype("<i8").tobytes())
            at, n = int(starts[-1]), n + len(lengths)
        if out:
            out[1].write(np.array([at], "<i8").tobytes())
            for f in out:
                f.close()
            row = [[task.partitionId()], [f"{folder}/{name}"], [n], [at], [encode.dtype.itemsize]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "path", "n_docs", "n_tokens", "width"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    written = map_batches(ordered.select("doc_id", "text"), run, INDEX)
    written.write.parquet(f"{folder}/parts")
    parts = sorted(spark.read.parquet(f"{folder}/parts").collect())  # a row for each part, not for each document
    rows, docs_before, tokens_before = [], 0, 0
    for p in parts:
        rows.append((*p, docs_before, tokens_before))
        docs_before, tokens_before = docs_before + p.n_docs, tokens_before + p.n_tokens
    index = spark.createDataFrame(rows, f"{INDEX}, doc_base long, token_base long")
    index.coalesce(1).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def mapped(path: str) -> pa.Buffer:
    """A file's bytes: memory-mapped where the folder is a mounted one, else read from its store."""
    fs, name = pafs.FileSystem.from_uri(path)
    if fs.type_name == "local":
        with pa.memory_map(name) as f:
            return f.read_buffer()
    with fs.open_input_file(name) as f:
        return f.read_buffer()


READ = "doc_id long, start long, n_tokens long, ids binary"


def read_tokens(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """Per document: id, number of ids before it, of its own, and these as little-endian uint32 (or their crc32)."""
    index = spark.read.parquet(f"{folder}/index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                flat = np.frombuffer(mapped(f"{part['path']}.ids"), f"<u{part['width']}")
                cuts = np.frombuffer(mapped(f"{part['path']}.offsets"), "<i8")
                owners = np.frombuffer(mapped(f"{part['path']}.docs"), "<i8")
                for i in range(0, len(owners), 2048):
                    own = owners[i : i + 2048]
                    marks = cuts[i : i + len(own) + 1]
                    wide = flat[marks[0] : marks[-1]].astype("<u4")
                    ends = (marks - marks[0]).tolist()
                    each = [wide[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                    last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest_only else pa.array(each, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(marks[:-1] + part["token_base"]), pa.array(np.diff(marks)), last],
                        ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"],
                    )

    schema = READ.replace("ids binary", "ids_crc32 long") if digest_only else READ
    return map_batches(index.repartition(max(1, index.count()), "part"), run, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder, digest_only=True)
