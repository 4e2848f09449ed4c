"""Strings that recur, and what a Python worker remembers of them: each distinct one of a batch is looked up once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What a string costs in a memory besides its characters and ids, measured: key, number and places in the arrays.
OVERHEAD = 190


def marked_parts(texts: pa.Array, before: str) -> pa.ListArray:
    """Texts without NUL, cut before each ``before`` (one character) and around each line end; empty parts may come."""
    return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, before, "\0" + before), "\n", "\0\n\0"), "\0")


def distinct(values: pa.Array, plain: bool = True) -> tuple[np.ndarray, list]:
    """A number for each value (string or binary) and the distinct values by number. ``plain``: no value has a NUL."""
    coded = values.dictionary_encode()
    known, n = coded.dictionary, len(coded.dictionary)
    if plain and n:
        nul = b"\0" if pa.types.is_binary(values.type) else "\0"
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), known), nul)[0].as_py().split(nul)
    else:
        words = known.to_pylist()
    return coded.indices.to_numpy(), words


def words_of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of the words (between ASCII white space) of all texts (no nulls), one text after the other; where each text's
    words begin, and the end; the distinct words by number, in UTF-8. An empty one may be among them, but has no place."""
    lists = pc.ascii_split_whitespace(texts)
    codes, words = distinct(lists.flatten().cast(pa.binary()), not pc.any(pc.match_substring(texts, "\0")).as_py())
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if b"" in words:
        real = codes != words.index(b"")
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return codes, offsets, words


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """64-bit hashes of the words of each text; null texts have none."""
    codes, offsets, words = words_of_texts(pc.fill_null(texts, ""))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.split(own[codes], offsets[1:-1]) if len(texts) else []


def spans(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[starts[r] : starts[r + 1]] of all rows, one after the other, and their sizes (32 bits: callers pass batches)."""
    first = starts[rows]
    sizes = starts[1:][rows] - first
    at = np.repeat(first - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], sizes


def of_each(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the stretches values[offsets[i] : offsets[i + 1]], which follow each other; equal stretches have equal sums."""
    real = offsets[1:] > offsets[:-1]
    out = np.zeros(len(real), np.float64 if values.dtype.kind == "f" else np.int64)
    if real.any():
        out[real] = np.add.reduceat(values, offsets[:-1][real], dtype=out.dtype)
    return out


class Memory:
    """Strings with their ids and ``width`` further numbers, in two generations of ``most_bytes`` / 2 each.

    A young generation that is full becomes the old one; what is still asked for moves over, the rest goes
    when the next one is full. Beyond that only one batch's strings are held.
    """

    def __init__(self, solve: Callable[[list[str]], list[tuple]], dtype: np.dtype, width: int, most_bytes: int):
        self.solve, self.dtype, self.width, self.most = solve, dtype, width, most_bytes // 2
        self.start()
        self.old = self.place, self.flat, self.starts, self.values

    def start(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.values = np.zeros(0, self.dtype), np.zeros(1, np.int32), np.zeros((0, self.width))
        self.held = 0

    def add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        n = len(self.place)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int32)))
        self.flat, self.values = np.concatenate((self.flat, flat)), np.concatenate((self.values, values))
        self.held += len(words) * OVERHEAD + sum(map(len, words)) + flat.nbytes

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each of these distinct strings, for ``flat``, ``starts`` and ``values``; holds until the next call."""
        if self.held > self.most:
            self.old = self.place, self.flat, self.starts, self.values
            self.start()
        found = list(map(self.place.get, words))
        if None in found:
            missing = [w for w, f in zip(words, found, strict=True) if f is None]
            place, flat, starts, values = self.old
            before = list(map(place.get, missing))
            again = [w for w, f in zip(missing, before, strict=True) if f is not None]
            rows = np.array([f for f in before if f is not None], np.int32)
            if again:
                self.add(again, *spans(flat, starts, rows), values[rows])
            new = [w for w, f in zip(missing, before, strict=True) if f is None]
            if new:
                solved = self.solve(new)
                own = np.frombuffer(b"".join([s[0] for s in solved]), self.dtype)
                sizes = np.fromiter((len(s[0]) for s in solved), np.int32, len(new)) // self.dtype.itemsize
                self.add(new, own, sizes, np.array([s[1:] for s in solved], np.float64).reshape(len(new), self.width))
            found = list(map(self.place.__getitem__, words))
        return np.array(found, np.int32)
