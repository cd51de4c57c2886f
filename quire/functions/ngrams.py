"""Hashed words and word pairs of texts, inside tasks: sparse counts made once per text, and vectors from them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from quire import fixed

#: Letters, digits and underscore: the same characters as fixed.WORD.
_WORD = re.compile(r"\w{2,}")
#: A pair's number is the first word's times this plus the second one's.
PAIR_FACTOR = 31
#: Characters of text, or cells of a dense matrix, handled at once.
_CHARS, _CELLS = 1 << 21, 1 << 21


class WordCodes(dict):
    """The first 32 bits of each word's md5; words a worker has met are remembered, up to a bound."""

    MOST = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        return code


_codes = WordCodes()


def _term_codes(terms: list[str]) -> np.ndarray:
    """The first 32 bits of each term's md5; most pairs of words occur once, so none are remembered."""
    if not terms:
        return np.zeros(0, np.int64)
    coded = "\n".join(terms).encode().split(b"\n")  # no term holds a line end
    return np.frombuffer(b"".join([hashlib.md5(t, usedforsecurity=False).digest() for t in coded]), ">u4")[::4].astype(np.int64)


def _counted(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of cells below n, ascending, and how often each occurs."""
    if n > 8 * len(cells):
        return np.unique(cells, return_counts=True)
    count = np.bincount(cells, minlength=n)
    found = np.flatnonzero(count)
    return found, count[found]


def count_ngrams(texts: list[str], dim: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of buckets of each text, and all buckets with their counts, ascending within a text.

    With ``whole`` a pair is hashed as a term of its own, its words with a space between; else its number comes from the words' numbers.
    """
    words = [_WORD.findall(t.lower()) for t in texts]
    length = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter(map(_codes.__getitem__, chain.from_iterable(words)), np.int64, int(length.sum()))
    owner = np.repeat(np.arange(len(texts)), length) * dim
    beside = owner[1:] == owner[:-1]
    if whole:
        terms = list(map(" ".join, chain.from_iterable(zip(own, own[1:]) for own in words)))
        pairs = np.zeros(max(0, len(code) - 1), np.int64)
        pairs[beside] = _term_codes(terms) % dim
    else:
        pairs = (code[:-1] * PAIR_FACTOR + code[1:]) % dim
    cell, count = _counted(np.concatenate([owner + code % dim, (owner[1:] + pairs)[beside]]), len(texts) * dim)
    return np.bincount(cell // dim, minlength=len(texts)), cell % dim, count


def sparse_batches(batches: Iterator[pa.RecordBatch], column: str, dim: int, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows with `buckets` and `counts` of a text column (null for a null text)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= _CHARS):
                size += len(texts[end] or "")
                end += 1
            part = texts[at:end]
            length, buckets, counts = count_ngrams([t or "" for t in part], dim, whole)
            edges = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            absent = pa.array([t is None for t in part])
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32)), mask=absent) for x in (buckets, counts)]
            yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, *lists], [*batch.schema.names, "buckets", "counts"])
            at = end


def scaled(counts: np.ndarray, buckets: np.ndarray, row: np.ndarray, rows: int, idf: np.ndarray | None) -> np.ndarray:
    """Weights of unit length in each row; without idf those of the plain counts."""
    raw = counts.astype(float) if idf is None else counts * idf[buckets]
    size = np.sqrt(np.bincount(row, weights=raw * raw, minlength=rows))
    return raw / size[row]


def weight_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray | None, name: str, dim: int | None) -> Iterator[pa.RecordBatch]:
    """The rows with unit-length weights of their sparse counts, dense with `dim`, else as long as `buckets`."""
    for batch in batches:
        step = max(1, _CELLS // (dim or fixed.EMBEDDING_DIM))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            lists = [part.column(part.schema.get_field_index(c)) for c in ("buckets", "counts")]
            n, absent = part.num_rows, lists[0].is_null()
            length = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buckets, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            row = np.repeat(np.arange(n), length)
            weights = scaled(counts, buckets, row, n, idf)
            if dim is not None:
                dense = np.zeros((n, dim))
                dense[row, buckets] = weights
                weights, length = dense.ravel(), np.full(n, dim)
            edges = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(edges, pa.array(weights), mask=absent)], [*part.schema.names, name])
