"""Groups of sets that link by exact Jaccard similarity, from candidate keys: leaders, then size-banded tiles.

Equal sets are one class (a node). Classes that share a key are candidates.

1. Leaders. In each bucket of equal keys the smallest class leads and is
   compared with the others, so a group of copies costs a comparison per member.
2. Tiles. Buckets that still hold classes of several components are joined to
   neighbourhoods (a class is in one only). A neighbourhood is ordered by size
   and cut into blocks of bounded bytes; two blocks whose sizes can link form a
   tile. A tile carries the sets, so pairs are decided where they meet, pairs
   within a component are skipped, and a union-find lets at most one link less
   than the tile has rows leave the task. No list of pairs arises.

A comparison first bounds sizes, then the overlap by signatures (see Rule);
what is left is intersected exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import discard, running, save
from quire.llm.words import mixed, slices, windows, word_hashes
from quire.session import cut_lineage

WORDS = 5
#: Bytes of sets (SMALLEST each at least) in a block; a tile holds two blocks.
BLOCK_BYTES = 4 << 20
SMALLEST = 8192
#: Partners of a leader that are compared in one task.
CHUNK = 256
#: Links whose components one task can settle (some tens of MB).
EDGES = 250_000
#: Sets intersected at once with another one.
STEP = 64

_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class Rule(NamedTuple):
    """Two sets link when denominator * intersection >= numerator * union.

    `near(sizes, signatures, other sizes, other signatures)` is false only for
    rows that cannot link (or by a stated, negligible chance).
    """

    numerator: int
    denominator: int
    near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; empty for one without words."""
    words = [t.lower().split() for t in texts]
    hashes = word_hashes([w for text in words for w in text])
    out, at = [], 0
    for text in words:
        own = hashes[at : at + len(text)]
        out.append(np.unique(windows(own, min(WORDS, len(own)))) if len(own) else own)
        at += len(text)
    return out


def set_node(found: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int(np.bitwise_xor(mixed(found + _SECOND).sum(dtype=np.uint64), np.uint64(len(found))).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def set_classes(sets: DataFrame) -> DataFrame:
    """node, doc_id, text_key, size and all other columns: one document for each distinct set, that of the smallest id (a null id last)."""
    others = [c for c in sets.columns if c not in ("node", "doc_id", "text_key", "n_shingles")]
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", F.col("n_shingles").alias("size"), *others)
    found = sets.where("node is not null").groupBy("node").agg(F.min(place).alias("p"))
    return found.select("node", "p.doc_id", "p.text_key", "p.size", *[f"p.{c}" for c in others])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of the links (src, dst): the smallest node that links reach.

    Each round hangs every node under the least node around it, first those
    above, then those below: a logarithmic number of rounds, each of map-side
    minima and joins on nodes, so a node with many links is never collected.
    Once EDGES or fewer links are left, one task settles them.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    edges = cut_lineage(links.select(high.alias("high"), low.alias("low")).where("high <> low").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now.n <= EDGES:
            return edges.coalesce(1).mapInArrow(_settled, "node long, component long")
        if now == before:
            break
        before = now
        swapped = edges.select(F.col("low").alias("high"), F.col("high").alias("low"))
        least = edges.unionByName(swapped).groupBy("high").agg(F.min("low").alias("least")).select(F.col("high").alias("node"), F.least("high", "least").alias("least"))
        raised = edges.select(F.col("high").alias("up"), F.col("low").alias("node")).join(least, "node").select(F.col("up").alias("high"), F.col("least").alias("low"))
        raised = raised.where("high <> low").distinct()
        floor = raised.groupBy("high").agg(F.min("low").alias("least"))
        hung = raised.join(floor, "high")
        edges = hung.select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(hung.select("high", F.col("least").alias("low")))
        edges = cut_lineage(edges.where("high <> low").distinct())
    tops = edges.select(F.col("low").alias("node"), F.col("low").alias("component"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(tops).groupBy("node").agg(F.min("component").alias("component"))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of at most EDGES edges, by hooking labels onto smaller ones and jumping."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    ends = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    nodes, place = np.unique(ends, return_inverse=True)
    place = place.reshape(ends.shape)
    label = np.arange(len(nodes))
    while True:
        own = label[place]
        if (own[0] == own[1]).all():
            break
        np.minimum.at(label, own.max(axis=0), own.min(axis=0))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column with equally long rows as a matrix of 64-bit numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _plausible(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that sizes and signatures do not rule out."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("signature").alias(f"signature_{side}")), side)
    pairs = pairs.where(F.least("size_a", "size_b") * rule.denominator >= F.greatest("size_a", "size_b") * rule.numerator)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = rule.near(batch.column(2).to_numpy(), _matrix(batch.column(3)), batch.column(4).to_numpy(), _matrix(batch.column(5)))
                yield batch.select(["a", "b"]).filter(pa.array(held))

    return pairs.select("a", "b", "size_a", "signature_a", "size_b", "signature_b").mapInArrow(near, "a long, b long")


def _with_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `wanted` (node, doc_id, text_key and others) with the set of each node as bytes (`shingles`)."""
    others = [c for c in wanted.columns if c not in ("doc_id", "text_key")]
    rest = [c for c in others if c != "node"]
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                distinct = {t: None for t in texts}
                found = dict(zip(distinct, shingle_sets(list(distinct))))
                node = part.column(1).to_pylist()
                own = [i for i, t in enumerate(texts) if len(found[t]) and set_node(found[t]) == node[i]]
                kept = part.select(["node", *rest]).take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([found[texts[i]].tobytes() for i in own], pa.binary())], ["node", *rest, "shingles"])

    texts = keyed(docs)
    # a null id may be that of many rows; each of its texts is read once
    unnamed = texts.where("doc_id is null").dropDuplicates(["text_key"])
    texts = texts.where("doc_id is not null").unionByName(unnamed).withColumn("at", F.coalesce("doc_id", F.lit(-(2**63))))
    # the same plan at every size: both sides by id, never the growing list of ids to all tasks
    same = (F.col("at") == F.coalesce("_id", F.lit(-(2**63)))) & (F.col("text_key") == F.col("_key"))
    kinds = dict(wanted.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["node", *rest])
    return texts.join(wanted.hint("merge"), same).select("text", "node", *rest).mapInArrow(sets, schema + ", shingles binary")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link (src, dst), by exact intersection.

    A leader comes with up to CHUNK or so of its partners; the sets of a
    popular one go to several tasks.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    spread = pairs.join(degree, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).cast("int"))
    members = spread.select(F.col("b").alias("node"), "a", "chunk", F.lit(1).alias("role"))
    heads = spread.select(F.col("a").alias("node"), "a", "chunk", F.lit(0).alias("role")).distinct()
    wanted = members.unionByName(heads).join(classes.select("node", "doc_id", "text_key"), "node")
    wanted = save(wanted.select("doc_id", "text_key", "node", "a", "chunk", "role"), "wanted")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, head = None, None
        for batch in batches:
            out = []
            for node, a, chunk, role, data in zip(*[batch.column(i) for i in range(5)]):
                own = np.frombuffer(data.as_py(), np.uint64)
                if role.as_py() == 0:
                    tile, head = (a.as_py(), chunk.as_py()), own
                    continue
                if tile != (a.as_py(), chunk.as_py()):
                    raise ValueError("a tile without its head")
                at = np.searchsorted(head, own)
                overlap = int(np.count_nonzero(head[np.minimum(at, len(head) - 1)] == own))
                if rule.denominator * overlap >= rule.numerator * (len(head) + len(own) - overlap):
                    out.append((a.as_py(), node.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["src", "dst"])

    tiles = _with_sets(wanted, docs).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    linked = save(tiles.mapInArrow(links, "src long, dst long").distinct(), "links")
    discard(wanted)
    return linked


def tile_links(tile: pa.RecordBatch, rule: Rule) -> pa.RecordBatch:
    """Links (src, dst) that join components in a tile: rows of node, component, block, size, signature, shingles.

    Rows of one block are compared with those of the other one, or with one
    another if there is one block only.
    """
    size = tile.column(3).to_numpy()
    order = np.argsort(size, kind="stable")
    tile, size = tile.take(pa.array(order)), size[order]
    node, block = tile.column(0).to_numpy(), tile.column(2).to_numpy()
    label = np.unique(tile.column(1).to_numpy(), return_inverse=True)[1]
    signature = _matrix(tile.column(4))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column(5)]
    one = block.min() == block.max()
    # the band of sizes that a row can link with: itself up to the largest one
    top = np.searchsorted(size, size * rule.denominator // rule.numerator, side="right")
    src, dst = [], []
    for x in range(len(node)):
        y = np.arange(x + 1, top[x])
        y = y[(label[y] != label[x]) & (one | (block[y] != block[x]))]
        if len(y):
            y = y[rule.near(size[y], signature[y], size[x], signature[x])]
        while len(y):
            now, y = y[:STEP], y[STEP:]
            flat = np.concatenate([sets[k] for k in now])
            at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
            overlap = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(size[now]) - size[now])
            for k in now[rule.denominator * overlap >= rule.numerator * (size[now] + size[x] - overlap)]:
                if label[k] != label[x]:
                    src.append(min(node[x], node[k]))
                    dst.append(max(node[x], node[k]))
                    label[label == label[k]] = label[x]
            y = y[label[y] != label[x]]
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _tile_links(members: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links (src, dst) across the components of neighbourhoods given as (hood, node, component).

    The largest component of a neighbourhood comes first and needs no tiles of
    its own; within it and behind it classes are ordered by size.
    """
    parts = members.groupBy("hood", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy("hood").agg(F.max(F.struct("n", "component")).alias("m")).select("hood", F.col("m.component").alias("_main"))
    rows = members.join(most, "hood").join(classes.select("node", "doc_id", "text_key", "size", "signature"), "node")
    rows = rows.withColumn("apart", F.col("component") != F.col("_main")).withColumn("weight", F.greatest(F.col("size") * 8, F.lit(SMALLEST))).drop("_main")
    rows = running(rows, [F.col("apart"), F.col("size"), F.col("node")], ["weight"], ["hood"])
    rows = save(rows.withColumn("block", F.floor(F.col("weight_before") / BLOCK_BYTES)).drop("weight", "weight_before", "apart"), "blocks")
    blocks = rows.groupBy("hood", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    left, right = (blocks.select("hood", *[F.col(c).alias(c + side) for c in ("block", "lo", "hi", "c0", "c1")]) for side in ("_i", "_j"))
    within = (F.col("hi_i") * rule.denominator >= F.col("lo_j") * rule.numerator) & (F.col("hi_j") * rule.denominator >= F.col("lo_i") * rule.numerator)
    one = (F.col("c0_i") == F.col("c1_i")) & (F.col("c0_j") == F.col("c1_j")) & (F.col("c0_i") == F.col("c0_j"))
    tiles = left.join(right, "hood").where("block_i <= block_j").where(within & ~one).select("hood", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    tiles = save(tiles, "tiles")
    sets = save(_with_sets(rows, docs), "sets")
    ends = tiles.withColumn("block", F.col("i")).unionByName(tiles.where("i <> j").withColumn("block", F.col("j")))
    spread = sets.join(ends, ["hood", "block"]).select("node", "component", "block", "size", "signature", "shingles", "hood", "i", "j")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in (6, 7, 8)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tile != tuple(key[:, a]):
                    if held:
                        yield tile_links(pa.concat_batches(held), rule)
                    tile, held = tuple(key[:, a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield tile_links(pa.concat_batches(held), rule)

    spread = spread.repartition("hood", "i", "j").sortWithinPartitions("hood", "i", "j")
    found = save(spread.mapInArrow(links, "src long, dst long").distinct(), "links")
    for table in (rows, tiles, sets):
        discard(table)
    return found


def linked_classes(docs: DataFrame, classes: DataFrame, keys: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the classes that link with others, and the links (src, dst) that connect them.

    `keys` (node, key) must give a common key to any two classes that can
    link; `classes` is that of set_classes().
    """
    heads = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    rows = save(keys.join(heads, "key").where("node <> lead"), "buckets")
    pairs = save(rows.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = _verify(save(_plausible(pairs, classes, rule), "plausible"), classes, docs, rule)
    label = save(components(links), "components")

    def component(side: str) -> DataFrame:
        return label.select(F.col("node").alias(side), F.col("component").alias("c_" + side))

    def known(side: str):
        return F.coalesce("c_" + side, side)

    apart = pairs.join(component("a"), "a", "left").join(component("b"), "b", "left").where(known("a") != known("b"))
    # a bucket of two is settled by the leader's comparison
    large = rows.where("n > 2").select("key", "lead", "node")
    open_keys = large.join(apart.select(F.col("a").alias("lead"), F.col("b").alias("node")), ["lead", "node"]).select("key").distinct()
    spokes = save(large.join(open_keys, "key", "left_semi").select(F.col("lead").alias("src"), F.col("node").alias("dst")).distinct(), "spokes")
    if not spokes.isEmpty():
        hoods = components(spokes).select("node", F.col("component").alias("hood"))
        members = hoods.join(label, "node", "left").select("hood", "node", F.coalesce("component", "node").alias("component"))
        links = links.unionByName(_tile_links(save(members, "hoods"), classes, docs, rule))
        label = save(components(links), "components")
    for table in (rows, pairs, spokes):
        discard(table)
    return label, links


def named_groups(members: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of `members` (doc_id, text_key, node and others) with component_id and `first_key`.

    component_id is the smallest doc_id of the group, null if it has none;
    first_key is the text_key of the document that stands for the group: that
    of the smallest (doc_id, text_key), null ids last. Both are the row's own without words.
    """
    label = label.select("node", "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("f")
    known = classes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id", "text_key")
    top = known.groupBy("component").agg(first).select("component", F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key"))
    named = save(known.select("node", "component").join(top, "component").drop("component"), "named")
    joined = members.join(named, "node", "left")
    none = F.col("node").isNull()
    return joined.select(
        *members.columns, F.when(none, F.col("doc_id")).otherwise(F.col("_id")).alias("component_id"), F.when(none, F.col("text_key")).otherwise(F.col("_key")).alias("first_key")
    )


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their group; rows that repeat both id and text stay once."""
    stands = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    stands = stands.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.withColumn("_text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    return rows.join(stands, same, "left_semi").dropDuplicates(["doc_id", "_text_key"]).select(docs.columns)
