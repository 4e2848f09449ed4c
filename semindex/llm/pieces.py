"""SentencePiece encoding and decoding with N-best segmentation.

A text, normalised by the model's own rules, is a lattice whose edges are the model's pieces. Forward
Viterbi gives the best score up to every position; a backward A* search from the end takes that score as
its heuristic. It is exact, so complete segmentations come off the heap in order of their score.

No piece reaches over the start of a word (a word mark after another character) or over a character that
occurs in no longer piece, such as a line end, so the lattice is a chain of small ones. The parts of an Arrow
batch are dictionary-encoded; each distinct one is searched once and remembered, within a bound of bytes, for
all the documents of a Python worker, and ids are gathered by numpy. The N best of a document are merged
exactly from those of its parts: only the parts that lose least by their second choice can take part in them.

Scores are the model file's. A character without a piece costs 10 more than the worst piece and falls
back to its bytes, or to the unknown id. Of equal scores any order may come, the same for equal parts.

Defined cases: null text counts as empty, which has no ids, one segmentation of score 0, and decodes to
""; each row stands alone, so repeated rows get equal results; input columns keep their names, but for
those of MADE and DECODED, which are replaced.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semindex.llm.common import gathered, map_batches, table
from semindex.llm.spellings import Memory, distinct, marked_parts, of_each, spans

#: Segmentations asked for; bytes of parts that a Python worker remembers; parts whose N best it remembers.
BEST, MEMORY, FOUND = 4, 80 << 20, 20_000
#: Longer parts are not solved side by side.
LONG = 64
MARK = "▁"
MADE = "ids array<int>, n_tokens long, score double, nbest array<struct<score:double,changes:array<struct<at:int,drop:int,ids:array<int>>>>>"
DECODED = "decoded string"


class Spelling:
    """What decoding needs of a model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        surface = [b""] * len(ids)
        for i in self.plain:
            surface[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            surface[i] = bytes([b])
        surface[self.unknown] = " ⁇ ".encode()
        self.surface = pa.array(surface, pa.binary())
        self.prefixed = sp.normalize("a").startswith(MARK)

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The text that each list of ids stands for; bytes that are no UTF-8 become U+FFFD."""
        raw = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.surface.take(lists.values)), b"")
        try:
            texts = raw.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
        return pc.replace_substring_regex(texts, r"\A ", "", max_replacements=1) if self.prefixed else texts

    def decode(self, ids: list[int]) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


class PieceLattice(Spelling):
    def __init__(self, path: str):
        super().__init__(path)
        sp = self.sp
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in self.plain}
        #: Pieces with score and ids; what only starts a piece has None.
        self.prefixes = {p[:j]: None for p in self.pieces for j in range(1, len(p))} | {p: (s, (i,)) for p, (i, s) in self.pieces.items()}
        self.pairs = {p[j : j + 2] for p in self.pieces for j in range(len(p) - 1)}
        self.trie = self.built()
        self.worst = min(s for _, s in self.pieces.values() if s > -1e8) - 10
        self.words = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.lines = "\n" not in "".join(p for p in self.pieces if len(p) > 1)
        alone = "" if not self.lines else r"|(?<=\n)|(?=\n)"
        self.cuts = re.compile(f"(?<=[^{MARK}])(?={MARK}){alone}")
        self.memory = Memory(self.solved, np.dtype(np.int32), 2, MEMORY)
        self.found: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def built(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces as a tree of characters: sorted edges (node << 21 | character), where they lead, each node's piece (or -1) and its score."""
        number = {p: k + 1 for k, p in enumerate(self.prefixes)}
        edges = sorted(((number.get(p[:-1], 0) << 21) | ord(p[-1]), k) for p, k in number.items())
        known = [None, *self.prefixes.values()]
        return (
            np.array([e for e, _ in edges]), np.array([k for _, k in edges]),
            np.array([v[1][0] if v else -1 for v in known]), np.array([v[0] if v else 0.0 for v in known]),
        )

    def solve_many(self, parts: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """solve() of many short parts, side by side: the same two passes, a start position and a length of piece at a time."""
        keys, leads, piece, worth = self.trie
        out = {}
        for begin in range(0, len(parts), 8_192):
            some = parts[begin : begin + 8_192]
            n, sizes = len(some), np.fromiter(map(len, some), np.int64, min(8_192, len(parts) - begin))
            longest = int(sizes.max())
            chars = np.zeros((n, longest), np.int64)
            chars[np.arange(longest) < sizes[:, None]] = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
            best = np.full((n, longest + 1), -np.inf)
            best[:, 0] = 0
            back, taken = np.zeros((n, longest + 1), np.int64), np.zeros((n, longest + 1), np.int64)
            found = []  # edges: rows, start, end, score
            for i in range(longest):
                rows = np.flatnonzero(sizes > i)
                node = np.zeros(len(rows), np.int64)
                for j in range(i, longest):
                    if j > i:
                        inside = sizes[rows] > j
                        rows, node = rows[inside], node[inside]
                    wanted = node << 21 | chars[rows, j]
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = keys[at] == wanted
                    rows, node = rows[hit], leads[at[hit]]
                    if not len(rows):
                        break
                    whole = piece[node] >= 0
                    own, ids, score = rows[whole], piece[node[whole]], worth[node[whole]]
                    if len(own):
                        found.append((own, i, j + 1, score))
                        total = best[own, i] + score
                        better = total > best[own, j + 1]
                        best[own[better], j + 1], back[own[better], j + 1], taken[own[better], j + 1] = total[better], i, ids[better]
            reached = np.isfinite(best[np.arange(n), sizes])
            # The best path, from its end; where it enters each position.
            entered, path, count = np.full((n, longest + 1), -1), np.zeros((n, longest), np.int32), np.zeros(n, np.int64)
            rows, at = np.flatnonzero(reached), sizes[reached]
            while len(rows):
                entered[rows, at] = back[rows, at]
                path[rows, count[rows]] = taken[rows, at]
                count[rows] += 1
                at = back[rows, at]
                rows, at = rows[at > 0], at[at > 0]
            rest = np.full((n, longest + 1), -np.inf)
            rest[np.arange(n), sizes] = 0
            second = np.full(n, -np.inf)
            for own, i, j, score in reversed(found):
                onward = score + rest[own, j]
                rest[own, i] = np.maximum(rest[own, i], onward)
                off = entered[own, j] != i
                second[own[off]] = np.maximum(second[own[off]], (best[own, i] + onward)[off])
            totals = best[np.arange(n), sizes]
            lost = (totals - np.where(reached, second, 0)).tolist()
            raw, width = path[:, ::-1].tobytes(), 4 * longest
            for k, (part, c, total, ok) in enumerate(zip(some, count.tolist(), totals.tolist(), reached.tolist(), strict=True)):
                out[part] = (raw[(k + 1) * width - 4 * c : (k + 1) * width], total, lost[k]) if ok else self.solve(part)
        return out

    def solved(self, parts: list[str]) -> list[tuple[bytes, float, float]]:
        """solve() of each: cut where no piece has both neighbours, and the cuts solved together."""
        pairs, held, missing, joint = self.pairs, {"": (b"", 0.0, math.inf)}, set(), []
        for part in parts:
            if part[1:].isalpha():  # rarely cut, and needn't be
                subs = [part]
            elif part[1:-1].isalpha():  # most often a word with a point or comma
                subs = [part[:-1], part[-1]] if part[-2:] not in pairs else [part]
            else:
                cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in pairs]
                subs = [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]
            if len(subs) > 1:
                joint.append((part, subs))
            missing.update(subs)
        missing.discard("")
        held |= {x: self.solve(x) for x in missing if len(x) > LONG}
        held |= self.solve_many(sorted((x for x in missing if len(x) <= LONG), key=len))
        for part, subs in joint:
            ids, scores, losses = zip(*(held[x] for x in subs), strict=True)
            held[part] = b"".join(ids), math.fsum(scores), min(losses)
        return [held[p] for p in parts]

    def edges(self, part: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """Edges (start, end, score, ids), by start and end."""
        n, get, out = len(part), self.prefixes.get, []
        for i in range(n):
            for j in range(i + 1, n + 1):
                known = get(part[i:j], False)
                if known:
                    out.append((i, j, *known))
                elif j == i + 1:
                    out.append((i, j, self.worst, tuple(self.bytes[b] for b in part[i].encode()) if self.bytes else (self.unknown,)))
                if known is False:
                    break
        return out

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids) of a part, best first."""
        end = len(part)
        best, into = [0.0] + [-math.inf] * end, [[] for _ in range(end + 1)]
        for i, j, s, ids in self.edges(part):
            into[j].append((i, s, ids))
            best[j] = max(best[j], best[i] + s)
        # Entries: total, position, number, score of the tail, tail as a linked list. Of equal totals the one
        # nearest to the start goes first, so ties don't fan out.
        heap: list[tuple] = [(-best[end], end, 0, 0.0, None)]
        out, count = [], 0
        while heap and len(out) < n:
            _, at, _, gained, tail = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((gained, tuple(ids)))
                continue
            for i, s, own in into[at]:
                count += 1
                heapq.heappush(heap, (-(best[i] + (s + gained)), i, count, s + gained, (own, tail)))
        return out

    def solve(self, part: str) -> tuple[bytes, float, float]:
        """Ids of the best segmentation, its score, and what the second choice loses at least: the
        second choice has an edge off the best path, and scores no more than the best path over that edge."""
        n, edges = len(part), self.edges(part)
        best, back = [0.0] + [-math.inf] * n, [edges[0]] * (n + 1)
        for edge in edges:
            if (score := best[edge[0]] + edge[2]) > best[edge[1]]:
                best[edge[1]], back[edge[1]] = score, edge
        path, at = {}, n  # by end
        while at:
            path[at] = back[at]
            at = back[at][0]
        lost = math.inf
        if len(edges) > len(path):
            rest, second = [-math.inf] * n + [0.0], -math.inf
            for edge in reversed(edges):
                i, j, s, _ = edge
                if (score := s + rest[j]) > rest[i]:
                    rest[i] = score
                if score + best[i] > second and path.get(j) is not edge:
                    second = score + best[i]
            lost = best[n] - second
        ids = array("i", [x for end in sorted(path) for x in path[end][3]])
        return ids.tobytes(), best[n], lost

    def others(self, part: str, n: int, own_best: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
        """The best n - 1 segmentations of a part besides the best; those of parts that recur are remembered."""
        if (held := self.found.get((part, n))) is None:
            if len(self.found) >= FOUND:
                self.found.clear()
            held = [(s, other) for s, other in self.search(part, n) if other != own_best][: n - 1]
            if len(part) <= LONG:
                self.found[part, n] = held
        return held

    def parts(self, texts: list[str]) -> pa.ListArray:
        """The chain of lattices of each normalised text; empty parts may be among them."""
        if not self.words or not self.lines or any("\0" in t for t in texts):
            return pa.array([[p for p in self.cuts.split(t) if p] if self.words else [t] for t in texts], pa.list_(pa.string()))
        lists = pa.array(texts, pa.string())
        if not pc.any(pc.match_substring(lists, MARK + MARK)).as_py():
            return marked_parts(lists, MARK)
        # Marks in a row are one part with what follows: each round joins every second of those that are left.
        marked = pc.replace_substring(pc.replace_substring(lists, MARK, "\0" + MARK), "\n", "\0\n\0")
        while pc.any(pc.match_substring(marked, MARK + "\0" + MARK)).as_py():
            marked = pc.replace_substring(marked, MARK + "\0" + MARK, MARK + MARK)
        return pc.split_pattern(marked, "\0")

    def encode_batch(self, texts: list[str], n: int = BEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """Ids of the best segmentations (int32), one text after the other, how many each has, their scores, and the n best of each
        text as (score, changes of the best one's ids)."""
        normal = [self.sp.normalize(t) if t else "" for t in texts]
        lists = self.parts(normal)
        codes, words = distinct(lists.flatten(), not any("\0" in t for t in normal))
        rows = self.memory.rows(words)[codes]
        ids, sizes = spans(self.memory.flat, self.memory.starts, rows)
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        values, lost = self.memory.values[rows, 0], self.memory.values[rows, 1]
        counts, totals = of_each(sizes, offsets), of_each(values, offsets)
        before = np.concatenate(([0], np.cumsum(sizes)))
        best = []
        for a, b, score in zip(offsets.tolist(), offsets[1:].tolist(), totals.tolist(), strict=False):
            merged: list[tuple[float, tuple]] = [(0.0, ())]
            few = a + np.argsort(lost[a:b], kind="stable")[: n - 1]
            for k in sorted(few[np.isfinite(lost[few])].tolist()):
                at, size = int(before[k]), int(sizes[k])
                others = self.others(words[codes[k]], n, tuple(ids[at : at + size].tolist()))
                options = [(0.0, ())] + [(float(values[k]) - s, ((at - int(before[a]), size, other),)) for s, other in others]
                merged = sorted(((x + y, p + q) for x, p in merged for y, q in options), key=lambda m: m)[:n]
            best.append([(score - less, list(changes)) for less, changes in merged])
        return ids, counts, totals, best

    def encode(self, text: str, n: int = BEST) -> tuple[bytes, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """encode_batch() of one text, its ids as bytes."""
        ids, _, scores, best = self.encode_batch([text], n)
        return ids.tobytes(), float(scores[0]), best[0]


@functools.cache
def lattice(path: str) -> PieceLattice:
    """One for a Python worker: its tasks share what it remembers."""
    return PieceLattice(path)


@functools.cache
def spelling(path: str) -> Spelling:
    return Spelling(path)


def encode_pieces(docs: DataFrame, model: str, n: int = BEST, with_text: bool = False) -> DataFrame:
    """docs (text, ...) with MADE; ``nbest`` starts with the best segmentation, which changes nothing. ``with_text`` adds
    what the ids decode to, as decode_pieces() does, without a second pass through Python."""
    made = T.StructType.fromDDL(MADE + f", {DECODED}" * with_text)
    docs = docs.drop(*made.names)
    names = [*docs.columns, *made.names]
    at = names.index("text")
    int_list = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lattice(model).encode_batch
        for batch in gathered(batches, 1000, 3 << 20):
            ids, counts, scores, best = encode([t or "" for t in batch.column(at).to_pylist()], n)
            each = [x for b in best for x in b]
            changes = [c for _, own in each for c in own]
            changed = pa.StructArray.from_arrays(
                [pa.array([c[0] for c in changes], pa.int32()), pa.array([c[1] for c in changes], pa.int32()), int_list([len(c[2]) for c in changes], pa.array([i for c in changes for i in c[2]], pa.int32()))],
                ["at", "drop", "ids"],
            )
            nbest = pa.StructArray.from_arrays([pa.array([s for s, _ in each], pa.float64()), int_list([len(own) for _, own in each], changed)], ["score", "changes"])
            lists = int_list(counts, pa.array(ids))
            arrays = [lists, pa.array(counts, pa.int64()), pa.array(scores, pa.float64()), int_list([len(b) for b in best], nbest)]
            if with_text:
                arrays.append(lattice(model).decode_lists(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names)

    return map_batches(docs, run, T.StructType([*docs.schema.fields, *made.fields]))


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (ids, ...) with the text that its ids stand for; null ids give null."""
    encoded = encoded.drop("decoded")
    names = [*encoded.columns, "decoded"]
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = spelling(model).decode_lists
        for batch in batches:
            ids = batch.column(at)
            own = pa.ListArray.from_arrays(ids.offsets, ids.values)  # nulls as empty lists
            texts = pc.if_else(pc.is_valid(ids), decode(own), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names)

    return map_batches(encoded, run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ids, the scores of the four best segmentations, and whether the ids decode to the text they came from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, model_path(), with_text=True)
    return out.select(
        "doc_id", "n_tokens", "ids", "score", F.col("nbest.score").alias("nbest_scores"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' ids in place of their texts."""
    return encode_pieces(docs.select("doc_id", "lang", "source", "text"), model_path()).select("doc_id", "lang", "source", "n_tokens", "ids", "score", F.col("nbest.score").alias("nbest_scores"))
