"""Vector code compression: integer codebooks per part, learnt and applied over Hilbert-sorted flat blocks.

Components become integers floor(SCALE * x); a vector is cut into equal
consecutive parts, each with a codebook of its own. Every part is sorted along
a Hilbert curve (neighbours on the curve are neighbours in space) by range
partitioning and stored in flat blocks with the least and greatest value of each
component (a box) and the sums of the components.

In a round each task compares boxes with entries first: an entry whose least
distance to the box exceeds the smallest greatest distance of any entry is
nearest to no part of the block, nor is one that another entry beats at every corner. A block left with one entry counts by its sums,
unread; the others are decided by exact integer arithmetic over their shortlist.
A task sends on a count and sums for each entry, never parts. The codebooks
(parts * entries * width integers, whatever the number of vectors) are all that
passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from quire.llm.store import discard, save

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts in a block.
BLOCK = 128
#: Magnitude of integer components up to which every sum below stays exact.
LARGEST = 1 << 24

_BLOCKS = "part int, n int, rows binary, x binary, lo binary, hi binary, total binary"


class Codebooks(NamedTuple):
    entries: np.ndarray  # part, entry, component
    scale: int

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (unique), vec_id, label, width, x (32-bit integers as bytes) of all usable vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            values = column.flatten()
            flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            length = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            owner = np.repeat(np.arange(len(length)), length)
            bad = np.bincount(owner[~np.isfinite(flat)], minlength=len(length)) > 0
            use = np.flatnonzero(~bad & (length > 0))
            whole = np.floor(flat[~bad[owner]] * scale)
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST} after scaling cannot be summed exactly")
            data = whole.astype("<i4").tobytes()
            ends = np.cumsum(length[use]) * 4
            x = [data[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist() if len(use) else [], ends.tolist())]
            own = batch.select([0, 1, 2]).take(pa.array(use))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(length[use].astype(np.int32)), pa.array(x, pa.binary())], ["row", "vec_id", "label", "width", "x"])

    kind = vectors.schema["label"].dataType.simpleString()
    columns = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return columns.mapInArrow(rows, f"row long, vec_id long, label {kind}, width int, x binary")


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with `bits` bits in each dimension, as signed 64-bit numbers in curve order.

    Turns coordinates into the transposed index one bit plane at a time
    (exchange or invert the lower bits, then Gray code), for all points at once.
    """
    axes = cells.T.astype(np.uint64)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = np.uint64(plane - 1)
        for i in range(len(axes)):
            inside = (axes[i] & np.uint64(plane)) != 0
            swap = np.where(inside, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(inside, low, swap)
            axes[i] ^= swap
        plane >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint64(b)) & np.uint64(1) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    axes ^= turn
    key = np.zeros(axes.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | ((axis >> np.uint64(b)) & np.uint64(1))
    key <<= np.uint64(64 - bits * len(axes))
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def hilbert_blocks(kept: DataFrame, parts: int, width: int, block: int = BLOCK) -> DataFrame:
    """The parts of integer vectors (row, x) in curve order, as flat blocks."""
    # the curve uses up to 64 dimensions and 64 bits; cells cover two standard deviations on both sides
    dims = min(width, 64)
    bits = min(8, 64 // dims)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.sum()]), pa.array([(x * x).sum()])], ["n", "s", "q"])

    n, s, q = kept.select("x").mapInArrow(moments, "n long, s double, q double").agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    mean = s / n
    reach = 2 * max(q / n - mean * mean, 0.0) ** 0.5 or 1.0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(batch.num_rows, parts, width)
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p])
                cells = np.clip((own[:, :dims] - mean + reach) * ((1 << bits) / (2 * reach)), 0, (1 << bits) - 1).astype(np.int64)
                data = own.tobytes()
                column = pa.array([data[4 * width * k : 4 * width * (k + 1)] for k in range(len(own))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, np.int32)), pa.array(curve_keys(cells, bits)), batch.column(0), column], ["part", "key", "row", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole blocks of what is held; the rest too at the end of the task."""
            if not held:
                return
            part, row, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            out, edges = [], [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                final = last or b < len(part)
                for at in range(a, b, block):
                    own = x[at : min(at + block, b)]
                    if len(own) < block and not final:
                        held.append((part[at:b], row[at:b], x[at:b]))
                        break
                    lo, hi, total = own.min(axis=0), own.max(axis=0), own.sum(axis=0, dtype=np.int64)
                    out.append((int(part[at]), len(own), row[at : at + len(own)].tobytes(), own.tobytes(), lo.tobytes(), hi.tobytes(), total.tobytes()))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(-1, width)
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), x))
                yield from blocks(last=False)
        yield from blocks(last=True)

    spread = kept.select("row", "x").mapInArrow(cut, "part int, key long, row long, x binary")
    order = [F.col(c) for c in ("part", "key", "row")]
    return spread.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "row", "x").mapInArrow(pack, _BLOCKS)


def shortlist(lo: np.ndarray, hi: np.ndarray, middle: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to a point of the box, in ascending order.

    An entry goes if its least distance to the box exceeds the smallest greatest one, or
    if the entry nearest to `middle` is nearer to every point: to the corner that favours the other one most.
    """
    outside = np.maximum(np.maximum(lo - entries, entries - hi), 0)
    furthest = np.maximum(np.abs(entries - lo), np.abs(entries - hi))
    near = np.flatnonzero((outside * outside).sum(axis=1) <= (furthest * furthest).sum(axis=1).min())
    left = entries[near]
    off = left - middle
    best = left[(off * off).sum(axis=1).argmin()]
    corner = np.where(left > best, hi, lo)
    own, other = corner - left, corner - best
    return near[(own * own).sum(axis=1) <= (other * other).sum(axis=1)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers its nearest entry (ties: the first) and the squared distance, exactly."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    own, others = x.astype(kind), entries.astype(kind)
    rest = (others * others).sum(axis=1) - 2 * (own @ others.T)
    best = rest.argmin(axis=1)
    return best, ((own * own).sum(axis=1) + rest[np.arange(len(x)), best]).astype(np.int64)


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    for part, n, rows, x, lo, hi, total in zip(*[c.to_pylist() for c in batch.columns]):
        yield part, n, np.frombuffer(rows, np.int64), np.frombuffer(x, "<i4").reshape(n, width), np.frombuffer(lo, "<i4").astype(np.int64), np.frombuffer(hi, "<i4").astype(np.int64), np.frombuffer(total, np.int64)


def _entry_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n, total (sums as bytes) over all parts nearest to each entry."""
    parts, entries, width = books.shape
    schema = "part int, entry int, n long, total binary"

    def sums(count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        part, entry = np.nonzero(count)
        data = [t.tobytes() for t in total[part, entry]]
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(data, pa.binary())], ["part", "entry", "n", "total"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for part, n, _, x, lo, hi, whole in _unpacked(batch, width):
                near = shortlist(lo, hi, whole // n, books[part])
                if len(near) == 1:
                    count[part, near[0]] += n
                    total[part, near[0]] += whole
                    continue
                own = near[nearest(x, books[part][near])[0]]
                count[part] += np.bincount(own, minlength=entries)
                order = np.argsort(own, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))
                total[part, own[order][heads]] += np.add.reduceat(x[order].astype(np.int64), heads, axis=0)
        yield sums(count, total)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for part, entry, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                count[part, entry] += n
                total[part, entry] += np.frombuffer(data, np.int64)
        yield sums(count, total)

    return blocks.mapInArrow(assign, schema).repartition("part", "entry").mapInArrow(combine, schema)


def _assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """row, part, entry, error of every part."""
    width = books.shape[2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, n, row, x, lo, hi, whole in _unpacked(batch, width):
                near = shortlist(lo, hi, whole // n, books[part])
                best, error = nearest(x, books[part][near])
                out.append((row, np.full(n, part, np.int32), near[best], error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(4)], ["row", "part", "entry", "error"])

    return blocks.mapInArrow(rows, "row long, part int, entry long, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (two hex digits a part), error of every usable vector; and the codebooks (None without vectors).

    Codebooks start as the parts of the `entries` (256 at most) smallest vec_ids (equal ones by their
    integers, null last; there are fewer entries if there are fewer vectors) and are moved to the floor of the
    mean in each round; unused entries stay. Ties go to the lower entry.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do those of
    another length than the smallest vec_id's, or of one that the parts do not divide. One row for each vector left:
    repeated ids and rows included. A scaled component beyond 2^24 is an error. Other columns are ignored.
    """
    if not 0 < entries <= 256 or not 0 < parts <= 7:
        raise ValueError("a code has two hex digits for each of up to seven parts")
    kept = save(integer_vectors(vectors).where(F.col("width") % parts == 0), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = kept.orderBy(*order).select("width").first()
    if first is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    kept = kept.where(F.col("width") == first.width)
    width = first.width // parts
    start = kept.orderBy(*order).select("x").limit(entries).collect()
    books = np.stack([np.frombuffer(r.x, "<i4").reshape(parts, width) for r in start], axis=1).astype(np.int64)
    blocks = save(hilbert_blocks(kept, parts, width), "blocks")
    for _ in range(rounds):
        books = books.copy()
        for part, entry, n, total in _entry_sums(blocks, books).collect():
            books[part, entry] = np.frombuffer(total, np.int64) // n
    digits = F.sum(F.col("entry") * F.pow(F.lit(256), F.lit(parts - 1) - F.col("part")).cast("long"))
    coded = _assigned(blocks, books).groupBy("row").agg(F.lower(F.lpad(F.hex(digits), 2 * parts, "0")).alias("code"), F.sum("error").alias("error"))
    coded = save(kept.select("row", "vec_id", "label").join(coded, "row").drop("row"), "codes")
    discard(blocks)
    return coded, Codebooks(books, SCALE)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The rows of `codes` with `approximation`: the entries of each code, scaled back."""
    parts = books.entries.shape[0]
    table = books.entries / books.scale

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column(batch.schema.get_field_index("code")).to_pylist())), np.uint8).reshape(-1, parts)
            found = np.concatenate([table[p, code[:, p]] for p in range(parts)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "approximation"])

    return codes.mapInArrow(rows, StructType(list(codes.schema)).add("approximation", ArrayType(DoubleType())))


def coded_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256."""
    coded, books = vector_codes(vectors)
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
