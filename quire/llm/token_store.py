"""Token ids in binary shard files with a minimal perfect hash index for keyed access.

A shard holds documents in ascending key order. File format (little-endian):

    magic 8 bytes | header length u32 | header JSON: name -> [place, count, kind] | sections

Sections: `ids` (u16 where the vocabulary fits, else u32; all documents one
after another), `first` and `count`
(u64, per document), `keys` (i64) with `known` (u8: key not null), and the
index: `bits` and `ranks` (u64, per 64 slots of all levels), `levels` (u64,
slots of each level), and per slot `row` (u64), `rows` (u64) and `print` (u64).

The index is built in levels: keys that fall alone on a slot of a level stay
there, the others go to the next level. The number of set bits before a key's
bit is its slot, so n keys have exactly the slots 0..n-1. The stored fingerprint
of the slot tells foreign keys apart. A lookup reads a few words, whatever n is.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.store import fresh_name, one_file_a_task, read_bytes, running, save, write_bytes
from quire.llm.words import Memo, mixed, slices
from quire.session import scratch_path

MAGIC = b"QUIRETS1"
SLACK = 2  # slots of a level for each key that comes to it
SHARD_IDS = 8 << 20
ROWS_READ = 64  # documents of one key that are read at once
NEAR = 64  # words of a section between two that are read together

_FILES = "part int, number int, file string, low long, high long, documents long, tokens long"
_PRINT = np.uint64(0xA5A5_5A5A_1234_5678)


def _place(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(slots)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return mixed(keys.view(np.uint64) ^ _PRINT)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, bits: np.ndarray, ranks: np.ndarray, levels: np.ndarray):
        self.bits, self.ranks, self.levels = bits, ranks, levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        marks, levels = [], []
        while len(keys):
            slots = max(64, -(-SLACK * len(keys) // 64) * 64)
            at = _place(keys, len(levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            marks.append(alone)
            levels.append(slots)
            keys = keys[~alone[at]]
        flags = np.concatenate(marks) if marks else np.zeros(0, bool)
        bits = np.packbits(flags, bitorder="little").view(np.uint64) if len(flags) else np.zeros(0, np.uint64)
        counts = np.bitwise_count(bits).astype(np.uint64)
        return cls(bits, np.cumsum(counts, dtype=np.uint64) - counts, np.array(levels, np.uint64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has a bit for it (such a key is foreign)."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, slots in enumerate(self.levels.astype(np.int64).tolist()):
            if not len(left):
                break
            at = base + _place(keys[left], level, slots)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            there = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[there]] = (self.ranks[word] + np.bitwise_count(below))[there].astype(np.int64)
            left, base = left[~there], base + slots
        return out


def pack(keys: list[int | None], ids: np.ndarray, count: np.ndarray, vocabulary: int) -> list[bytes]:
    """One shard: documents in key order (null keys first), equal keys side by side."""
    known = np.array([k is not None for k in keys], np.uint8)
    values = np.array([0 if k is None else k for k in keys], np.int64)
    own = np.flatnonzero(known)
    distinct, first, times = np.unique(values[own], return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slot(distinct)
    row, rows, prints = (np.zeros(len(distinct), np.uint64) for _ in range(3))
    row[slot], rows[slot], prints[slot] = own[first], times, fingerprint(distinct)
    sections = {
        "ids": ids.astype("<u2" if vocabulary <= 1 << 16 else "<u4"), "first": (np.cumsum(count) - count).astype("<u8"), "count": count.astype("<u8"), "keys": values.astype("<i8"),
        "known": known, "bits": index.bits, "ranks": index.ranks, "levels": index.levels, "row": row, "rows": rows, "print": prints,
    }
    table, place = {}, 0
    for name, data in sections.items():
        table[name] = [place, len(data), data.dtype.str]
        place += -(-data.nbytes // 8) * 8
    header = json.dumps(table).encode()
    header += b" " * (-(12 + len(header)) % 8)
    parts = [MAGIC, struct.pack("<I", len(header)), header]
    for data in sections.values():
        parts.append(data.tobytes() + b"\0" * (-data.nbytes % 8))
    return parts


class Shard:
    """A shard file; sections are views of its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack_from("<I", data, 8)[0]
        for name, (place, n, kind) in json.loads(data[12 : 12 + size]).items():
            setattr(self, name, np.frombuffer(data, kind, n, 12 + size + place))
        self.index = PerfectHash(self.bits, self.ranks, self.levels)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for a key that is not in the shard."""
        slot = self.index.slot(keys)
        if not len(self.row):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.maximum(slot, 0)
        here = (slot >= 0) & (self.print[at] == fingerprint(keys))
        return np.where(here, self.row[at].astype(np.int64), 0), np.where(here, self.rows[at].astype(np.int64), 0)

    def documents(self, rows: np.ndarray) -> list[np.ndarray]:
        first, count = self.first[rows].astype(np.int64), self.count[rows].astype(np.int64)
        return [self.ids[a : a + n] for a, n in zip(first.tolist(), count.tolist())]


class StoredSection:
    """A section of a shard file that is read where it is asked for: words by place, or a slice."""

    def __init__(self, source: pa.NativeFile, place: int, n: int, kind: str):
        self.source, self.place, self.n, self.kind = source, place, n, np.dtype(kind)

    def __len__(self) -> int:
        return self.n

    def _read(self, a: int, b: int) -> np.ndarray:
        size = self.kind.itemsize
        return np.frombuffer(self.source.read_at((b - a) * size, self.place + a * size), self.kind)

    def __getitem__(self, places: np.ndarray | slice) -> np.ndarray:
        if isinstance(places, slice):
            return self._read(places.start, places.stop)
        wanted, back = np.unique(places, return_inverse=True)
        if not len(wanted):
            return np.zeros(0, self.kind)
        # neighbours within NEAR words come in one read
        cut = np.flatnonzero(np.diff(wanted) > NEAR) + 1
        runs = [(r - r[0], self._read(int(r[0]), int(r[-1]) + 1)) for r in np.split(wanted, cut)]
        return np.concatenate([data[at] for at, data in runs])[back]


class StoredShard(Shard):
    """A shard file of which only the header and what a lookup needs is read: a few words for each key, and its ids."""

    def __init__(self, source: pa.NativeFile):
        head = source.read_at(12, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack_from("<I", head, 8)[0]
        for name, (place, n, kind) in json.loads(source.read_at(size, 12)).items():
            setattr(self, name, StoredSection(source, 12 + size + place, n, kind))
        self.index = PerfectHash(self.bits, self.ranks, self.levels[0 : len(self.levels)])


# The tokenizer's pre-tokens, in lower case, within words of ASCII
# and the composed letters U+00C0 to U+00FF (which normalisation leaves as they are);
# words are given in lines.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")
LATIN = re.compile("[\x00-\x7fÀ-ÿ]*")
WORD_END = "</w>"


class WordEncoder:
    """A tokenizer of the `tokenizers` library, run over distinct words.

    White space is dropped by its pre-tokenizer and nothing crosses it, so the
    ids of a text are those of its words. New Latin words are cut into
    pre-tokens first, which are fewer; the library encodes new ones many in a
    call, told apart by their word ends. It encodes all other words as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.size = size
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])
        self.pre = Memo(self._encode_pre_tokens, 200_000)
        self.memo = Memo(self._encode, 300_000)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length

    def _encode_pre_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(words) or last[-1] != len(flat) - 1:
            return self._each(words)
        return flat, np.diff(last, prepend=-1)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lines = b"\n".join(words).decode()
        split = lines.split("\n")
        if LATIN.fullmatch(lines) and "<|" not in lines:
            plain, own, other = np.ones(len(split), bool), split, []
        else:
            plain = np.array([LATIN.fullmatch(w) is not None and "<|" not in w for w in split])
            own, other = ([w for w, p in zip(split, plain.tolist()) if p == kind] for kind in (True, False))
        count = np.empty(len(split), np.int64)
        flat, count[plain] = self._latin(own)
        if not other:
            return flat, count
        rest, count[~plain] = self._each(other)
        ids = np.empty(int(count.sum()), np.uint32)
        at = np.repeat(plain, count)
        ids[at], ids[~at] = flat, rest
        return ids, count

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = PRE_TOKENS.findall("\n".join([*words, ""]).lower())
        ends = np.flatnonzero([t == "\n" for t in found])
        tokens = [t for t in found if t != "\n"]
        ids, length = self.pre.lookup(tokens, len(tokens))
        edges = np.concatenate([[0], np.cumsum(length)])[ends - np.arange(len(ends))]
        return ids, np.diff(edges, prepend=0)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.memo.ids([t.split() for t in texts])


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every whole text and writes shards below `folder`; returns the manifest.

    Texts are range-partitioned by doc_id and sorted, encoded where they land,
    and written as soon as a shard has `shard_ids` ids, so a task holds one
    shard. Rows of an id that many have, or of none, may go to several shards and
    tasks (ranges also depend on how the text begins). Names are unique to each attempt; only the files of
    the manifest (stored, one row per shard) count. Manifest: part, number,
    file, low, high (keys), documents, tokens, tokens_before.
    Null texts are empty (one end id), null ids come first and have no key.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        keys, ids, counts, held, number = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name, count = fresh_name(folder, ".tokens"), np.concatenate(counts)
            write_bytes(name, pack(keys, np.concatenate(ids), count, max(words.size, end_id + 1)))
            named = [k for k in keys if k is not None]
            values = [part, number, name, min(named, default=None), max(named, default=None), len(keys), int(count.sum())]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in _FILES.split(", ")])

        part = 0
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                part = rows.column(2)[0].as_py()
                own = rows.column(0).to_pylist()
                if held >= shard_ids:
                    yield close()
                    keys, ids, counts, held, number = [], [], [], 0, number + 1
                flat, count = words.encode(texts)
                ends = np.cumsum(count)
                ids.append(np.insert(flat, ends, end_id))
                counts.append(count + 1)
                keys += own
                held += len(ids[-1])
        if keys:
            yield close()

    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spread = spread.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 40).asc_nulls_first())
    spread = spread.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())
    files = save(spread.mapInArrow(shards, _FILES), "shards")
    return save(running(files, [F.col("part"), F.col("number")], ["tokens"]), "manifest")


def scan(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read from the shards.

    Documents with a key are found through the index of their shard; a key that
    it does not lead to its own row is an error.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(read_bytes(name))
                known = shard.known.astype(bool)
                row, times = shard.find(shard.keys)
                place = np.arange(len(known))
                if ((place < row) | (place >= row + times))[known].any():
                    raise ValueError(f"the index of {name} misses keys")
                first, count = shard.first.astype(np.int64), shard.count.astype(np.int64)
                crc = [zlib.crc32(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys, mask=~known), pa.array(first + base), pa.array(count), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = one_file_a_task(manifest.select("file", "tokens_before"))
    return files.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, ids for each of the given keys that the store has (repeated documents give a row each).

    Keys are range-partitioned, so a task meets neighbouring keys. It reads the
    manifest rows of the shards that cover them and, of those, the header, the
    few index words that each key leads to and the ids of its documents.
    """
    folder = manifest.inputFiles()[0].rsplit("/", 1)[0] if manifest.inputFiles() else ""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            if not len(wanted):
                continue
            store, base = pafs.FileSystem.from_uri(folder)
            near = (pads.field("low") <= int(wanted[-1])) & (pads.field("high") >= int(wanted[0]))
            for file in pads.dataset(base, filesystem=store, format="parquet").to_table(["file", "low", "high"], filter=near).to_pylist():
                inside = wanted[(wanted >= file["low"]) & (wanted <= file["high"])]
                if not len(inside):
                    continue
                with store.open_input_file(pafs.FileSystem.from_uri(file["file"])[1]) as source:
                    shard = StoredShard(source)
                    row, times = shard.find(inside)
                    for key, a, n in zip(inside.tolist(), row.tolist(), times.tolist()):
                        for at in range(a, a + n, ROWS_READ):
                            ids = shard.documents(np.arange(at, min(at + ROWS_READ, a + n)))
                            yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids)), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    spread = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return spread.mapInArrow(rows, "doc_id long, ids array<long>")


def token_store(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes all documents to a store below the shared folder and returns what scan() reads back."""
    return scan(write_store(docs, path, scratch_path(docs.sparkSession, "tokens"), end_id))
