"""Folds along the rows of a key in order, for rules whose next step depends on a small running state.

Rows are range-partitioned by (key, order) and stored, so a key of any size
lies in as many partitions as its rows need. A task walks its partition from
state to state; only the first key of a partition may have begun in the one
before. What such a partition starts with is found by passes: every one walks the
stretches that reach into a next partition, first as if nothing came before,
then again (only where it changes anything) with the state the partition in front ended with.
States usually meet again within a few rows, so two passes are the rule; the
worst case is one for each partition of a key. Marks are counted apart from the
state, because counts add up.

What passes through the driver is a row for each partition.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quire.session import scratch_path

#: From a state (None at first) and columns of consecutive rows to a mark (0 or 1) for each row and the state behind them.
Step = Callable[..., tuple[list[int], object]]


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Step, pieces: int | None = None) -> DataFrame:
    """Adds `mark`, as `step` gives it, and `ord`: the number of marks of the key up to this row.

    `step` reads `columns` of the rows of a key in `order`, some at a time. Its
    state must survive JSON. `pieces` sets the number of partitions.
    """
    spark = rows.sparkSession
    along = [F.col(c) for c in (*keys, *order)]
    spread = rows.repartitionByRange(*([pieces] if pieces else []), *along).withColumn("_part", F.spark_partition_id())
    path = scratch_path(spark, "fold")
    spread.sortWithinPartitions(*along).write.parquet(path)
    table = spark.read.schema(spread.schema).parquet(path)

    whole = F.struct(*keys)
    spans = table.groupBy("_part").agg(F.min(whole).alias("first"), F.max(whole).alias("last")).orderBy("_part").collect()
    # partitions whose first key began in the one before
    source = {b["_part"]: a["_part"] for a, b in zip(spans, spans[1:]) if a["last"] == b["first"]}
    through = {s["_part"] for s in spans if s["first"] == s["last"] and s["_part"] in source}

    def walk(batches: Iterator[pa.RecordBatch], entries: dict, bases: dict) -> Iterator[tuple]:
        """(slice of a batch, marks, count before it) of consecutive rows of a key, and (part, state, count) behind each partition."""
        part = key = state = None
        count = 0
        for batch in batches:
            names = batch.schema.names
            ids = list(zip(*[batch.column(names.index(c)).to_pylist() for c in ("_part", *keys)]))
            values = [batch.column(names.index(c)).to_pylist() for c in columns]
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                if ids[at] != key:
                    if part is not None and ids[at][0] != part:
                        yield part, json.dumps(state), count
                    new = ids[at][0] != part
                    part, key = ids[at][0], ids[at]
                    state, count = (entries.get(part), bases.get(part, 0)) if new else (None, 0)
                marks, state = step(state, *[v[at:end] for v in values])
                yield batch.slice(at, end - at), marks, count
                count += sum(marks)
                at = end
        if part is not None:
            yield part, json.dumps(state), count

    def laid_out(df: DataFrame) -> DataFrame:
        return df.repartition("_part").sortWithinPartitions("_part", *along)

    def exits(parts: set[int], entries: dict) -> dict[int, tuple[object, int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = [x for x in walk(batches, entries, {}) if not isinstance(x[0], pa.RecordBatch)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["part", "state", "count"])

        ends = table.where(F.col("_part").isin(sorted(parts))).groupBy("_part").agg(F.max(whole).alias("_last"))
        mine = F.lit(True)
        for c in keys:
            mine = mine & F.col(c).eqNullSafe(F.col(f"_last.{c}"))
        last = table.join(ends, "_part").where(mine).select(*table.columns)
        return {r.part: (json.loads(r.state), r["count"]) for r in laid_out(last).mapInArrow(run, "part int, state string, count long").collect()}

    entries: dict = {}
    found: dict[int, tuple[object, int]] = {}
    again = set(source.values())
    while again:
        found |= exits(again, {p: entries.get(p) for p in again & through})
        before, entries = entries, {p: found[q][0] for p, q in source.items()}
        again = {p for p in entries if p in through and p in found and entries[p] != before.get(p)}
    bases: dict[int, int] = {}
    for p, q in sorted(source.items()):
        bases[p] = found[q][1] + (bases[q] if q in through else 0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def together() -> pa.RecordBatch:
            part = pa.concat_batches([h[0] for h in held])
            marks, ords = [m for h in held for m in h[1]], []
            for _, own, count in held:
                for m in own:
                    count += m
                    ords.append(count)
            held.clear()
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.int64()), pa.array(ords, pa.int64())], [*part.schema.names, "mark", "ord"])

        size = 0
        for x in walk(batches, entries, bases):
            if isinstance(x[0], pa.RecordBatch):
                held.append(x)
                size += x[0].num_rows
                if size >= 10_000:
                    yield together()
                    size = 0
        if held:
            yield together()

    schema = StructType([*table.schema.fields]).add("mark", LongType()).add("ord", LongType())
    return laid_out(table).mapInArrow(fold, schema).drop("_part")


def running_number(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of each row of its key in order, from 0."""
    numbered = ordered_fold(rows, keys, order, [order[0]], lambda state, x: ([1] * len(x), None))
    return numbered.withColumn(name, F.col("ord") - 1).drop("mark", "ord")
