"""Words of texts inside tasks: slices of batches, word memos, numpy hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone and whole.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows of a batch and their texts as UTF-8 (null: empty), `limit` bytes at a time."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, size, held = 0, 0, []
    for i, text in enumerate(texts.cast(pa.binary())):
        data = text.as_py() or b""
        if held and size + len(data) > limit:
            yield batch.slice(start, len(held)), held
            start, size, held = i, 0, []
        held.append(data)
        size += len(data)
    if held:
        yield batch.slice(start, len(held)), held


class Memo(dict):
    """Distinct words with their token ids, kept by a Python worker from task to task.

    `encode` turns new words into (flat ids, ids per word). Beyond `limit` words
    the memo starts again and keeps the words so far as an older generation,
    from which words come back without encoding; so its memory is bounded by two
    generations and a slice. Results never depend on it.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 200_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.older: dict = {}
        self.older_flat = self.older_first = self.older_length = np.zeros(0, np.int64)
        self._start()

    def _start(self) -> None:
        self.clear()
        self.fresh: list = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def reset(self) -> None:
        self.older = dict(self)
        self.older_flat, self.older_first, self.older_length = self.flat[: self.used], self.first[: len(self)], self.length[: len(self)]
        self._start()

    def __missing__(self, word):
        slot = len(self)
        self[word] = slot
        self.fresh.append(word)
        return slot

    def ids(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts given as lists of words: all ids, and the number of each text."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        flat, length = self.lookup(chain.from_iterable(texts), int(counts.sum()))
        edges = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(edges)

    def lookup(self, words: Iterable, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n words: all ids, and the number of each word."""
        if len(self) > self.limit:
            self.reset()
        slots = np.fromiter(map(self.__getitem__, words), np.int64, n)
        self._learn()
        length = self.length[slots]
        ends = np.cumsum(length)
        places = np.repeat(self.first[slots] - (ends - length), length) + np.arange(int(ends[-1]) if n else 0)
        return self.flat[places], length

    def _learn(self) -> None:
        if not self.fresh:
            return
        flat, length = self._known_or_encoded(self.fresh)
        old, new = len(self) - len(self.fresh), len(self)
        if new > len(self.first):
            grow = max(new, 2 * len(self.first)) - len(self.first)
            self.first, self.length = np.pad(self.first, (0, grow)), np.pad(self.length, (0, grow))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.pad(self.flat, (0, max(self.used + len(flat), 2 * len(self.flat)) - len(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[old:new] = length
        self.first[old:new] = self.used + np.cumsum(length) - length
        self.used += len(flat)
        self.fresh = []

    def _known_or_encoded(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        slots = np.fromiter((self.older.get(w, -1) for w in words), np.int64, len(words)) if self.older else np.full(len(words), -1)
        known = slots >= 0
        if not known.any():
            return self.encode(words)
        length = np.empty(len(words), np.int64)
        length[known] = self.older_length[slots[known]]
        new, length[~known] = self.encode([w for w, k in zip(words, known.tolist()) if not k]) if not known.all() else (np.zeros(0, np.uint32), [])
        flat = np.empty(int(length.sum()), np.uint32)
        own = np.repeat(known, length)
        size = length[known]
        ends = np.cumsum(size)
        flat[own] = self.older_flat[np.repeat(self.older_first[slots[known]] - (ends - size), size) + np.arange(int(ends[-1]))]
        flat[~own] = new
        return flat, length


_MIX = np.random.default_rng(20_240_501)
_LETTERS = _MIX.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads them evenly (the splitmix64 finaliser)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, then mixed with its length."""
    if not words:
        return np.zeros(0, np.uint64)
    data = _LETTERS[np.frombuffer(b"".join(words), np.uint8)]
    length = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(length) - length
    powers = np.full(int(length.max()), _FACTOR)
    powers[0] = 1
    powers = np.cumprod(powers)
    data *= powers[np.arange(len(data)) - np.repeat(first, length)]
    return mixed(np.add.reduceat(data, first) + length.astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive words (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= _FACTOR
        total += hashes[k : k + n]
    return mixed(total)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOW_LETTERS = _LETTERS[_LOWER]


def byte_words(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts joined by newlines: all bytes, first and end byte of each word, and a 64-bit hash (A-Z in lower case with `fold`)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.append(0, edge)
    first, end = edge[0::2], edge[1::2]
    if not len(first):
        return data, first, end, np.zeros(0, np.uint64)
    length = end - first
    powers = np.full(int(length.max()), _FACTOR)
    powers[0] = 1
    powers = np.cumprod(powers)
    values = (_LOW_LETTERS if fold else _LETTERS)[data[~blank]]
    starts = np.cumsum(length) - length
    values *= powers[np.arange(len(values)) - np.repeat(starts, length)]
    return data, first, end, mixed(np.add.reduceat(values, starts) + length.astype(np.uint64))
