"""Approximate nearest neighbours: a forest of sorted hash strings, searched by longest common prefix.

The index is cut into shards of bounded size by a hash of the vector; each
shard has TREES sorted arrays of BITS-bit strings (signs of random projections).
A query descends in every tree to its longest matching prefixes (two binary
searches per length) and then ascends in all trees at once, to shorter and
shorter prefixes, until enough candidates of the shard are under them. The
candidates are scored exactly; the best of all shards are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import save

TREES, BITS = 64, 32
#: Vectors of a shard, as a target.
SHARD = 8192
#: The ascent ends when this share of a shard (and FEWEST vectors) is under the prefixes.
SHARE = 0.4
FEWEST = 400


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """The sorted arrays of one shard of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, width = vectors.shape
        # With one more component all vectors have the same length, so the largest inner product is the smallest angle.
        square = (vectors**2).sum(axis=1)
        self.lift = float(square.max())
        self.mean = vectors.mean(axis=0)
        lifted = np.hstack([vectors - self.mean, np.sqrt(np.maximum(self.lift - square, 0))[:, None]])
        self.planes = np.random.default_rng(width).standard_normal((TREES, width + 1, BITS))
        self.order = np.empty((TREES, n), np.int64)
        self.strings = np.empty((TREES, n), np.uint32)
        for t in range(TREES):
            own = self._strings(lifted, t)
            self.order[t] = np.argsort(own, kind="stable")
            self.strings[t] = own[self.order[t]]

    def _strings(self, lifted: np.ndarray, tree: int) -> np.ndarray:
        signs = lifted @ self.planes[tree] > 0
        return np.packbits(signs, axis=1).view(">u4").ravel().astype(np.uint32)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Rows of the shard under each query's prefixes: `enough` of them at least, if there are so many."""
        lifted = np.hstack([queries - self.mean, np.zeros((len(queries), 1))])
        low = np.empty((BITS + 1, TREES, len(queries)), np.int64)
        high = np.empty_like(low)
        for t in range(TREES):
            own = self._strings(lifted, t)
            for length in range(BITS + 1):
                mask = np.uint32(((1 << length) - 1) << (BITS - length))
                low[length, t] = np.searchsorted(self.strings[t], own & mask, side="left")
                high[length, t] = np.searchsorted(self.strings[t], (own & mask) | ~mask, side="right")
        under = (high - low).sum(axis=1)
        n = len(self.vectors)
        for q in range(len(queries)):
            # the longest prefixes with enough entries, then shorter ones until enough are distinct
            length = int(np.flatnonzero(under[:, q] >= min(enough, n))[-1])
            while True:
                found = np.zeros(n, bool)
                for t in range(TREES):
                    found[self.order[t, low[length, t, q] : high[length, t, q]]] = True
                if length == 0 or np.count_nonzero(found) >= min(enough, n):
                    break
                length -= 1
            yield np.flatnonzero(found)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by inner product, ties to the smaller vec_id.

    `vectors` and `queries` have vec_id and embedding; a query's own row (the
    same id) is no candidate. Vectors and queries that are null, zero or hold
    null or non-finite components take no part, nor do null ids; vectors of
    another length than a query never meet it. Equal vectors are indexed once with
    their k + 1 smallest ids, which is all that an answer can hold of them, so
    copies cost nothing, however many. Repeated ids count once each.
    """
    good = [F.col("vec_id").isNotNull(), usable(F.col("embedding"))]
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(good[0]).where(good[1]).select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding"))
    # the group limit holds before the shuffle too: a task sends k + 1 rows of a vector at most
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1)
    distinct = save(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    width = F.size("embedding")
    shards = max(1, -(-distinct.count() // shard))
    index = distinct.select(width.alias("width"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"),
                            F.lit(None).cast("long").alias("query_id"), "ids", "embedding")
    asked = queries.where(good[0]).where(good[1]).select(F.col("vec_id").cast("long").alias("query_id"), wide.alias("embedding")).distinct()
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = asked.select(width.alias("width"), "shard", F.lit(1).alias("kind"), "query_id", F.array().cast("array<long>").alias("ids"), "embedding")

    def answer(forest: Forest, owners: list, ids: list, asked: list) -> list:
        points = np.array(asked)
        enough = max(FEWEST, int(np.ceil(share * len(owners))))
        out = []
        for query, point, rows in zip(ids, points, forest.candidates(points, enough)):
            score = (forest.vectors[rows] * point).sum(axis=1)
            # k + 1 rows hold k answers besides the query's own; ties at the end stay in
            cut = np.partition(score, -(k + 1))[-(k + 1)] if len(score) > k + 1 else -np.inf
            top = sorted((-s, i) for r, s in zip(rows[score >= cut], score[score >= cut]) for i in owners[r] if i != query)[:k]
            out += [(query, i, -s) for s, i in top]
        return out

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, owners, held, forest = None, [], [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            ids, asked, out = [], [], []
            for width, number, kind, query, own, vector in zip(*columns):
                if (width, number) != tile:
                    if asked:
                        out += answer(forest, owners, ids, asked)
                    tile, owners, held, forest, ids, asked = (width, number), [], [], None, [], []
                if kind == 0:
                    owners.append(own)
                    held.append(vector)
                    continue
                if forest is None:
                    if not held:
                        continue
                    forest = Forest(np.array(held))
                    held = []
                ids.append(query)
                asked.append(vector)
            if asked:
                out += answer(forest, owners, ids, asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"]
            )

    spread = index.unionByName(asked).repartition(shards, "width", "shard").sortWithinPartitions("width", "shard", "kind", "query_id")
    found = spread.mapInArrow(tiles, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
