"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy arrays."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quire.llm.words import Memo, slices

SPACE = "▁"
_NONE = np.iinfo(np.int64).max

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """Vocabulary of a SentencePiece BPE model: merges, scores and piece bytes.

    Holds for models with identity normalisation, a dummy prefix, byte fallback
    and no user-defined pieces; others are refused.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if not sp.is_byte(sp.piece_to_id("<0x00>")) or any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a BPE model with byte fallback and white space at word starts is needed")
        if sp.encode("Å  a") != sp.encode(" Å  a")[1:] and sp.decode(sp.encode("Å  a")) != "Å  a":
            raise ValueError("a model without normalisation is needed")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)

        known = {pieces[i]: i for i in plain}
        symbols = dict(known)  # and the characters that only occur inside pieces
        for piece in known:
            for c in piece:
                symbols.setdefault(c, n + len(symbols))
        self.size = max(symbols.values()) + 1
        self.vocabulary = n
        self.symbol = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        # scores in descending order; equal scores share a rank
        _, order = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)
        pairs, adjacent = {}, set()
        for piece, i in known.items():
            for k in range(1, len(piece)):
                adjacent.add((ord(piece[k - 1]) << 21) | ord(piece[k]))
                if piece[:k] in symbols and piece[k:] in symbols:
                    pairs[symbols[piece[:k]] * self.size + symbols[piece[k:]]] = i
        self.codes = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[c] for c in self.codes.tolist()], np.int64)
        self.rank = order[self.merged].astype(np.int64)
        self.adjacent = np.array(sorted(adjacent), np.int64)

        spelled = [bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        spelled[sp.unk_id()] = " ⁇ ".encode()
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelling = np.fromiter(map(len, spelled), np.int64, n)
        self.place = np.cumsum(self.spelling) - self.spelling
        self.memo = Memo(self.encode_words)

    # -- encoding

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments given without their leading space sign: all ids, and how many each has."""
        joined = "".join([SPACE + w for w in words]).replace(" ", SPACE)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        symbol = self.symbol[points]
        # Cut where no piece has the two characters side by side: no merge can cross.
        cut = np.ones(len(points), bool)
        code = (points[:-1] << 21) | points[1:]
        at = np.minimum(np.searchsorted(self.adjacent, code), len(self.adjacent) - 1)
        cut[1:] = self.adjacent[at] != code
        cut[np.cumsum(length)[:-1]] = True
        group = np.cumsum(cut) - 1
        final = np.full(len(points), -2, np.int64)
        doubtful = self._rounds(symbol.copy(), group, np.arange(len(points)), final, single=False)
        if len(doubtful):
            again = np.flatnonzero(np.isin(group, doubtful))
            final[again] = -2
            self._rounds(symbol[again], group[again], again, final, single=True)
        return self._spell(final, points, length)

    def _rounds(self, symbol: np.ndarray, group: np.ndarray, place: np.ndarray, final: np.ndarray, single: bool) -> np.ndarray:
        """Merge rounds until no pair remains; writes each symbol to its first place in `final`.

        In every round each group merges all its pairs of smallest rank, from
        the left, at once. One by one, a merge could open a pair of a rank that
        is no larger before the next equal pair came up; groups in which that
        happens are returned, to be done with one merge a round (`single`).
        """
        doubtful = []
        last = np.full(int(group[-1]) + 1 if len(group) else 0, -1, np.int64)  # rank of the latest round with several merges
        while len(symbol):
            code = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            fits = (self.codes[at] == code) & (group[:-1] == group[1:]) & (symbol[:-1] >= 0) & (symbol[1:] >= 0)
            rank = np.append(np.where(fits, self.rank[at], _NONE), _NONE)
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(group)))
            done = np.repeat(least == _NONE, size)
            final[place[done]] = symbol[done]
            best = np.repeat(least, size)
            take = (rank == best) & ~done
            step = np.arange(len(take))
            if single:
                first = np.minimum.reduceat(np.where(take, step, len(take)), head)
                take = step == np.repeat(first, size)
            else:
                # of overlapping pairs, every other one from the left
                since = np.maximum.accumulate(np.where(take, -1, step))
                take &= ((step - since) & 1) == 1
                mine = group[head]
                worse = (least != _NONE) & (last[mine] >= least)
                if worse.any():
                    doubtful.append(mine[worse])
                many = np.add.reduceat(take.astype(np.int64), head) > 1
                last[mine] = np.where(many, least, np.where(worse, _NONE, last[mine]))
            symbol[take] = self.merged[np.append(at, 0)[take]]
            keep = ~done
            keep[1:] &= ~take[:-1]
            symbol, group, place = symbol[keep], group[keep], place[keep]
        return np.unique(np.concatenate(doubtful)) if doubtful else np.zeros(0, np.int64)

    def _spell(self, final: np.ndarray, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the ids of their UTF-8 bytes."""
        used = np.flatnonzero(final != -2)
        symbol, word = final[used], np.repeat(np.arange(len(length)), length)[used]
        bare = (symbol < 0) | (symbol >= self.vocabulary)
        if not bare.any():
            return symbol.astype(np.uint32), np.bincount(word, minlength=len(length))
        count = np.ones(len(symbol), np.int64)
        spelled = {p: chr(p).encode("utf-8", "surrogatepass") for p in np.unique(points[used[bare]]).tolist()}
        count[bare] = [len(spelled[p]) for p in points[used[bare]].tolist()]
        ids = np.repeat(symbol, count)
        ids[np.repeat(bare, count)] = self.bytes[np.frombuffer(b"".join(spelled[p] for p in points[used[bare]].tolist()), np.uint8)]
        return ids.astype(np.uint32), np.bincount(word, weights=count, minlength=len(length)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, with begin and end ids: all ids, and the number of each text."""
        ids, count = self.memo.ids([segments(t) for t in texts])
        out = np.empty(len(ids) + 2 * len(texts), np.uint32)
        total = count + 2
        first = np.cumsum(total) - total
        inner = np.ones(len(out), bool)
        inner[first] = inner[first + total - 1] = False
        out[inner] = ids
        out[first], out[first + total - 1] = self.begin, self.end
        return out, total

    # -- decoding

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of consecutive id lists of the given lengths."""
        ids = ids.astype(np.int64)
        size = self.spelling[ids]
        ends = np.cumsum(size)
        data = self.letters[np.repeat(self.place[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            text = data[a + (data[a : a + 1] == b" " and a < b) : b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "each_byte").encode()
            out.append(text)
        return out


def segments(text: str) -> list[str]:
    """The text cut before each run of spaces; of each segment the first space sign is left out.

    With the dummy prefix every segment starts with a space sign, and no piece
    has one after another character, so segments are encoded each for itself.
    """
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return words
    out, blank = [], 0
    for w in words:
        if w:
            out.append(" " * blank + w)
            blank = 0
        else:
            blank += 1
    if blank:
        out.append(" " * (blank - 1))
    return out


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    """One model (and memo of words) for each Python worker."""
    return PieceModel(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array), decoded text, for every whole text.

    Null and empty texts give the begin and end ids and an empty text. One row
    per input row, repeated or null ids included; extra columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids, count = bpe.encode([t.decode() for t in texts])
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                decoded = pa.array([t.decode() for t in bpe.decode(ids, count)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: round_trip with the results hashed where they arise."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids, count = bpe.encode([t.decode() for t in texts])
                data, edges = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(count)]).tolist()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(count, pa.int64()),
                    pa.array([hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(edges, edges[1:])], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, count)], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
