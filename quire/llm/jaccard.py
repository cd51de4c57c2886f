"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

Documents are sets of 5-word shingles (64-bit hashes); equal sets are one class.
A class has BANDS keys, each from ROWS minimum hashes of its set. Two classes of
similarity s share no key with probability (1 - s^ROWS)^BANDS, which at 0.8 is
1.3e-12. Classes that share a passage only (similarity below 0.1) almost never
meet, however common the passage. Classes that meet are compared by
linking.linked_classes(): with the leader of their bucket first, the rest in
tiles of two size bands.

Before sets are intersected, sizes bound the overlap (a smaller set below 80 % of
a larger one cannot reach 0.8), then parity bitmaps: sets whose bitmaps differ
in d bits differ in d elements at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.linking import Rule, keyed, linked_classes, named_groups, one_of_each, set_classes, set_node, shingle_sets
from quire.llm.store import discard, save
from quire.llm.words import mixed, slices

NUMERATOR, DENOMINATOR = 80, 100
BANDS, ROWS = 52, 4
BITMAP = 1024

_MULTIPLIERS = (np.random.default_rng(5).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node (null for an empty set), bands, signature (the bitmap)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                sets = shingle_sets(texts)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(size)
                bands = np.zeros((len(sets), BANDS), np.int64)
                bits = np.zeros((len(sets), BITMAP // 64), np.int64)
                node = np.zeros(len(sets), np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    first = np.cumsum(size[full]) - size[full]
                    short = (flat >> np.uint64(32)).astype(np.uint32)
                    least = np.empty((BANDS * ROWS, len(full)), np.uint32)
                    for k, factor in enumerate(_MULTIPLIERS):
                        least[k] = np.minimum.reduceat(short * factor, first)
                    least = least.reshape(BANDS, ROWS, len(full)).astype(np.uint64)
                    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(full), 1)
                    for r in range(ROWS):
                        key = mixed(key * _SECOND + least[:, r])
                    bands[full] = key.T.view(np.int64)
                    # parity of the elements on each of the bitmap's places
                    places = np.repeat(np.arange(len(full)), size[full]) * BITMAP + (flat & np.uint64(BITMAP - 1)).astype(np.int64)
                    odd = (np.bincount(places, minlength=len(full) * BITMAP) & 1).astype(np.uint8)
                    bits[full] = np.packbits(odd, bitorder="little").view(np.int64).reshape(len(full), -1)
                    node[full] = [set_node(sets[i]) for i in full]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(size), pa.array(node, mask=size == 0),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, BITMAP // 64, dtype=np.int32)), pa.array(bits.ravel())),
                ], ["doc_id", "text_key", "n_shingles", "node", "bands", "signature"])

    return keyed(docs).mapInArrow(rows, "doc_id long, text_key long, n_shingles long, node long, bands array<long>, signature array<long>")


def near(size: np.ndarray, bits: np.ndarray, other: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """Whether bitmaps leave the similarity possible: with d differing elements the overlap is (sum of sizes - d) / 2 at most."""
    differ = np.bitwise_count((bits ^ other_bits).view(np.uint64)).sum(axis=1, dtype=np.int64)
    both = size + other
    return (both - differ) * (DENOMINATOR + NUMERATOR) >= 2 * NUMERATOR * both


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node, component_id, first_key, n_links: one row per input row (see jaccard_groups)."""
    full = save(signatures(docs), "signatures")
    members = save(full.select("doc_id", "text_key", "n_shingles", "node"), "members")
    classes = save(set_classes(full), "classes")
    discard(full)
    label, links = linked_classes(docs, classes, classes.select("node", F.explode("bands").alias("key")), Rule(NUMERATOR, DENOMINATOR, near))
    ends = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node")))
    counts = save(ends.groupBy("node").agg(F.count("*").alias("n_links")), "ends")
    found = named_groups(members, classes, label).join(counts, "node", "left")
    return found.select("doc_id", "text_key", "n_shingles", "node", "component_id", "first_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, one row per input row.

    component_id is the smallest doc_id reachable over links (the own one
    for a text without words, which links with nothing). n_links counts the
    links with other classes that were made: enough to connect each group, not
    every pair in it. Null texts have no words. Rows of a null id link as
    others do, but are never a component's id: a group of such rows alone has a
    null one. Repeated rows are equal texts; extra columns are ignored.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group: that of its smallest doc_id, with all columns.

    A group of null ids alone keeps one of its texts. Texts without words stay.
    Rows that repeat both id and text stay once; of several texts of the id that
    stands for a group, the one with the smallest hash.
    """
    return one_of_each(docs, grouped(docs))
