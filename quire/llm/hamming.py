"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures.

Documents are sets of 5-word shingles; equal sets are one class. The signature
of a class has CHUNKS * WIDTH symbols, each the low 16 bits of a minimum hash:
two sets of similarity s agree in a symbol with probability s (and 1 in 65,536 by chance).

The signature is split into CHUNKS chunks. By the pigeonhole principle two
signatures that differ in at most DISTANCE = CHUNKS * (ERRORS + 1) - 1 symbols
have a chunk with at most ERRORS differing ones, and so agree in one of the
chunk's keys: its other symbols when any ERRORS places are left out. Every pair
within DISTANCE thus shares a key. At similarity 0.85 a pair exceeds DISTANCE
(23 of 60) with probability 2.3e-06, and shares no key all the same with probability
4e-10. Pairs that meet at FURTHEST or more differing symbols are not compared
(2.1e-10 at 0.85); all others are intersected exactly (linking.linked_classes()).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.linking import Rule, keyed, linked_classes, named_groups, set_classes, set_node, shingle_sets
from quire.llm.store import discard, save
from quire.llm.words import mixed, slices

NUMERATOR, DENOMINATOR = 85, 100
CHUNKS, WIDTH, ERRORS = 12, 5, 1
SYMBOLS = CHUNKS * WIDTH
DISTANCE = CHUNKS * (ERRORS + 1) - 1
FURTHEST = 30

_MULTIPLIERS = (np.random.default_rng(12).integers(0, 1 << 31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: The places of a chunk that a key keeps.
_KEPT = list(combinations(range(WIDTH), WIDTH - ERRORS))


def symbols(sets: list[np.ndarray]) -> np.ndarray:
    """The signatures of sets that are not empty, as rows of 16-bit symbols."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    first = np.cumsum(size) - size
    short = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k, factor in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(short * factor, first) & np.uint32(0xFFFF)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node (null for an empty set), signature (symbols, four to a number)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                sets = shingle_sets(texts)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(size)
                node = np.zeros(len(sets), np.int64)
                packed = np.zeros((len(sets), SYMBOLS // 4), np.int64)
                if len(full):
                    packed[full] = symbols([sets[i] for i in full]).view(np.int64)
                    node[full] = [set_node(sets[i]) for i in full]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, SYMBOLS // 4, dtype=np.int32)), pa.array(packed.ravel()))
                columns = [part.column(0), part.column(1), pa.array(size), pa.array(node, mask=size == 0), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "node", "signature"])

    return keyed(docs).mapInArrow(rows, "doc_id long, text_key long, n_shingles long, node long, signature array<long>")


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of signatures (rows of symbols): for each chunk one for every choice of ERRORS places left out."""
    chunks = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(signature), CHUNKS, len(_KEPT)), np.uint64)
    for v, kept in enumerate(_KEPT):
        key = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(len(_KEPT)) + np.uint64(v)
        for place in kept:
            key = mixed(key * _FACTOR + chunks[:, :, place])
        out[:, :, v] = key
    return out.reshape(len(signature), -1).view(np.int64)


def class_keys(classes: DataFrame) -> DataFrame:
    """(node, key) of all keys of the classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                keys = chunk_keys(np.ascontiguousarray(packed).view(np.uint16))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "keys"])

    keys = classes.select("node", "signature").mapInArrow(rows, "node long, keys array<long>")
    return keys.select("node", F.explode("keys").alias("key"))


def distance(signature: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The number of symbols in which packed signatures differ."""
    return ((signature ^ other).view(np.uint16).reshape(len(signature), -1) != 0).sum(axis=1)


def near(size: np.ndarray, signature: np.ndarray, other: np.ndarray, other_signature: np.ndarray) -> np.ndarray:
    return distance(signature, other_signature) < FURTHEST


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per input row.

    component_id is the smallest doc_id reachable over links of similarity
    0.85 or more (the own one for a text without words, which links with
    nothing); kept tells the rows whose doc_id it is. Null texts have no words.
    Rows of a null id link as others do, but are never a component's id: a group
    of such rows alone has a null one, and its rows count as kept. Repeated rows
    are equal texts and share their result; extra columns are ignored.
    """
    full = save(signatures(docs), "signatures")
    members = save(full.select("doc_id", "text_key", "n_shingles", "node"), "members")
    classes = save(set_classes(full), "classes")
    discard(full)
    label, _ = linked_classes(docs, classes, class_keys(classes), Rule(NUMERATOR, DENOMINATOR, near))
    found = named_groups(members, classes, label)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
