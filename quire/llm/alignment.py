"""Cross-tokenizer alignment: two tokenisations of a text merged by byte ends, and how often ids are linked.

1. A task takes texts in slices of bounded bytes, encodes each with both
   tokenizers (a worker remembers the ids of words, bounded) and has the byte
   ends of all tokens as two flat arrays. They are merged in lockstep: one state vector
   holds the A and B pointers of all documents of the slice, a step compares
   both ends of each, advances the pointer that is behind, or both with a link and a cut
   where the ends are equal, and drops what is finished. A text of more than LANE bytes
   is several entries of the vector, each for the ends within its bytes, so a
   long document takes no more steps than a short one.
2. A slice leaves each document's links as numbers into the slice's own list of
   distinct id pairs. Counts of pairs are summed over all slices, the highest one for each
   B id is found, and both go back to the pairs of each slice by join: rows
   are distinct pairs of slices, not links, and nothing that grows is broadcast.
3. Slices meet their looked-up pairs (cogrouped by slice) and add them up for each document.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.pieces import segments
from quire.llm.store import save
from quire.llm.words import Memo, slices

#: Bytes of texts merged at once, and of one entry of the state vector.
SLICE, LANE = 2 << 20, 512
#: Elements spelled at once.
PIECE = 1 << 18
#: A text is cut before a single space between other characters: there byte-level pre-tokens start in any context.
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Tokens(NamedTuple):
    ids: np.ndarray
    count: np.ndarray  # tokens of each text
    length: np.ndarray  # bytes of each token


class TokenPair:
    """Both tokenizers with the bytes of their tokens: A byte-level (from a JSON file), B SentencePiece with byte fallback."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.space = self.b.piece_to_id("▁")
        n = self.b.vocab_size()
        spelled = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        for i in range(n):
            if self.b.is_control(i) or self.b.is_unknown(i):
                spelled[i] = b""
        self.letters_b, self.place_b = _flat(spelled)
        self.letters_a, self.place_a = _flat(_byte_level(self.a))
        self.length_a, self.length_b = np.diff(self.place_a), np.diff(self.place_b)
        self.memo_a = Memo(self._encode_a)
        self.memo_b = Memo(self._encode_b)

    def _encode_a(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _joined([e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)])

    def _encode_b(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the segment of a lone last space is empty: its space sign is the dummy prefix, which the library gives to no empty text
        return _joined([ids or [self.space] for ids in self.b.encode(words, num_threads=1)])

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of space + text by A and of text by B, as flat arrays; none for an empty text."""
        a, n_a = self.memo_a.ids([_CUT.split(" " + t) if t else [] for t in texts])
        b, n_b = self.memo_b.ids([segments(t) for t in texts])
        return Tokens(a, n_a, self.length_a[a]), Tokens(b, n_b, self.length_b[b])

    def matches(self, texts: list[bytes], a: Tokens, b: Tokens) -> np.ndarray:
        """Whether the joined bytes of the tokens of both are those of space + text."""
        want = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        good = np.ones(len(texts), bool)
        for tokens, letters, place in ((a, self.letters_a, self.place_a), (b, self.letters_b, self.place_b)):
            own = np.add.reduceat(np.append(tokens.length, 0), _firsts(tokens.count)) * (tokens.count > 0)
            good &= own == size
            data = _spelled(tokens.ids[np.repeat(good, tokens.count)], letters, place)
            held = want[np.repeat(good, size)]
            text = np.repeat(np.flatnonzero(good), size[good])
            good[text[data != held]] = False
        return good & (size > 0)


def _flat(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the first place of each element and the end."""
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))])


def _spelled(ids: np.ndarray, letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The bytes of elements one after another; places of few elements at a time are held."""
    out = []
    for at in range(0, len(ids), PIECE):
        own = ids[at : at + PIECE]
        size = place[own + 1] - place[own]
        ends = np.cumsum(size)
        out.append(letters[np.repeat(place[own] - (ends - size), size) + np.arange(int(ends[-1]))])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum())), count


def _firsts(count: np.ndarray) -> np.ndarray:
    """First place of each text's tokens."""
    return np.cumsum(count) - count


def _byte_level(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary.

    Its alphabet: printable Latin-1 characters stand for their own byte, the
    other bytes in order for the characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(own)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(others)}
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        if i not in special:
            out[i] = bytes(byte[c] for c in token)
    return out


@lru_cache(maxsize=2)
def token_pair(path_a: str, path_b: str) -> TokenPair:
    """One pair of tokenizers for each Python worker."""
    return TokenPair(path_a, path_b)


def merge_ends(end_a: np.ndarray, end_b: np.ndarray, size: int, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of tokens that end together, in order of their end.

    Ends are ascending byte offsets over a whole slice of `size` bytes, where
    texts follow one another. The state vector starts with an entry for every
    `lane` bytes, at the first tokens that end behind its start.
    """
    border = np.arange(0, size + lane, lane)
    at_a, at_b = np.searchsorted(end_a, border, side="right"), np.searchsorted(end_b, border, side="right")
    a, b, stop_a, stop_b = at_a[:-1].copy(), at_b[:-1].copy(), at_a[1:], at_b[1:]
    found_a, found_b = [], []
    while True:
        going = (a < stop_a) & (b < stop_b)
        if not going.all():  # compaction: a lane without tokens on one side has no more links
            a, b, stop_a, stop_b = a[going], b[going], stop_a[going], stop_b[going]
        if not len(a):
            break
        x, y = end_a[a], end_b[b]
        link = x == y
        found_a.append(a[link])
        found_b.append(b[link])
        a, b = a + (x <= y), b + (y <= x)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a)
    return a[order], b[order]


@lru_cache(maxsize=1)
def _decimals(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal numbers below `limit`, each with a comma behind it (see _flat)."""
    return _flat([f"{i},".encode() for i in range(limit)])


class Aligned(NamedTuple):
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray  # also the groups: each ends with a link
    pairs: np.ndarray  # of all links: A id in the upper, B id in the lower 32 bits
    groups: list[bytes]  # a1,a2|b1;a3|b2,b3


def align(pair: TokenPair, texts: list[bytes]) -> Aligned:
    """Counts, links and groups of each text; a text without matching tokens has none."""
    a, b = pair.encode([t.decode() for t in texts])
    good = pair.matches(texts, a, b)
    keep_a, keep_b = np.repeat(good, a.count), np.repeat(good, b.count)
    a = Tokens(a.ids[keep_a], a.count * good, a.length[keep_a])
    b = Tokens(b.ids[keep_b], b.count * good, b.length[keep_b])
    end_a, end_b = np.cumsum(a.length), np.cumsum(b.length)
    at_a, at_b = merge_ends(end_a, end_b, int(end_a[-1]) if len(end_a) else 0)
    link_text = np.repeat(np.arange(len(texts)), a.count)[at_a]
    pairs = (a.ids[at_a].astype(np.int64) << 32) | b.ids[at_b].astype(np.int64)

    # every token's group, then all tokens in the order A of a group, B of it, A of the next one
    group_a = np.searchsorted(at_a, np.arange(len(a.ids)))
    group_b = np.searchsorted(at_b, np.arange(len(b.ids)))
    before_b = np.concatenate([[0], at_b + 1])  # B tokens in earlier groups
    after_a = at_a + 1  # A tokens up to the end of a group
    place = np.concatenate([np.arange(len(a.ids)) + before_b[group_a], np.arange(len(b.ids)) + after_a[group_b]])
    ids = np.empty(len(place), np.int64)
    mark = np.full(len(place), ord(","), np.uint8)
    ids[place] = np.concatenate([a.ids, b.ids])
    mark[place[at_a]] = ord("|")
    mark[place[len(a.ids) + at_b]] = ord(";")
    letters, first = _decimals(max(len(pair.length_a), len(pair.length_b)))
    ends = np.cumsum(first[ids + 1] - first[ids])
    data = _spelled(ids, letters, first)
    data[ends - 1] = mark
    joined = data.tobytes()
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(a.count + b.count)])].tolist()
    groups = [joined[x : y - 1] if y > x else b"" for x, y in zip(edges, edges[1:])]
    return Aligned(a.count, b.count, np.bincount(link_text, minlength=len(texts)), pairs, groups)


_ROWS = "slice long, place int, doc_id {kind}, n_a long, n_b long, n_links long, groups string, links binary, pairs array<long>, times array<long>"


def aligned_slices(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """A row for each document with its slice, counts, groups (or their SHA-256) and links; its first row holds the slice's pairs and how often they occur."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(path_a, path_b)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                n = len(texts)
                found = align(pair, texts)
                pairs, index, times = np.unique(found.pairs, return_inverse=True, return_counts=True)
                data, edges = index.astype("<i4").tobytes(), [0, *(4 * np.cumsum(found.n_links)).tolist()]
                groups = [g.decode() if keep_groups or not g else hashlib.sha256(g).hexdigest() for g in found.groups]
                lists = [pa.ListArray.from_arrays(pa.array([0] + [len(pairs)] * n, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, uuid.uuid4().int >> 65, np.int64)), pa.array(np.arange(n, dtype=np.int32)), part.column(0),
                    pa.array(found.n_a, pa.int64()), pa.array(found.n_b, pa.int64()), pa.array(found.n_links, pa.int64()), pa.array(groups, pa.string()),
                    pa.array([data[x:y] for x, y in zip(edges, edges[1:])], pa.binary()), *lists,
                ], [c.split()[0] for c in _ROWS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(rows, _ROWS.format(kind=kind))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links that hold it in all documents), best (whether no other pair of its B id has more)."""
    pairs = aligned.where("place = 0").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = save(pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, one row per input row.

    A encodes a space and the text, B the text; special tokens' strings are plain text.
    Groups are the runs of A and B ids between byte offsets where tokens of both end
    (`a1,a2|b1;a3|b2,b3`; without `keep_groups` the SHA-256 of that). A link is a pair of tokens that end
    together; n_best counts a document's links whose pair is the most frequent one of its B id (ties included) in
    all documents, count_sum adds up the counts of its links' pairs. Texts that are null, empty, or whose tokens do not
    spell space and text have zeros and ''. Repeated rows count as often as they occur; ids may be null; extra columns are ignored.
    """
    aligned = save(aligned_slices(docs, path_a, path_b, keep_groups), "aligned")
    wanted = aligned.where("place = 0").select(F.col("slice").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    looked = wanted.join(pair_counts(aligned), "pair").select("of", "at", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        index = np.frombuffer(b"".join(left.column("links").to_pylist()), "<i4")
        edges = np.concatenate([[0], np.cumsum(left.column("n_links").to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[index])])[edges]) for x in (best, count)]
        columns = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_links", "n_links")]
        return pa.table([*columns, *map(pa.array, sums), left.column("groups")], names=[c.split()[0] for c in schema.split(", ")])

    rows = aligned.select("slice", "doc_id", "n_a", "n_b", "n_links", "groups", "links")
    return rows.groupBy("slice").cogroup(looked.groupBy("of")).applyInArrow(add_up, schema)


def alignment_digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """alignment() with groups_sha256 for groups."""
    return alignment(docs, path_a, path_b, keep_groups=False).withColumnRenamed("groups", "groups_sha256")
