"""Scratch tables and files in the shared folder, and running sums over a distributed order."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import prepare, scratch_path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe when executors are lost."""
    path = scratch_path(prepare(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table made by save() that no plan still to run depends on."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def one_file_a_task(manifest: DataFrame, most: int = 20_000) -> DataFrame:
    """Rows that name files, dealt out by file; the number of tasks follows the number of files."""
    return manifest.repartition(max(1, min(manifest.count(), most)), F.col("file"))


def fresh_name(folder: str, ending: str) -> str:
    """A file name that no other attempt of the same task can use."""
    return f"{folder}/{uuid.uuid4().hex}{ending}"


def write_bytes(path: str, parts: list[bytes]) -> None:
    """Write one file from a task, to any store that pyarrow reaches."""
    store, name = pafs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as out:
        for part in parts:
            out.write(part)


def read_bytes(path: str) -> bytes:
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as source:
        return source.read()


def running(df: DataFrame, order: list[Column], values: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds `<value>_before`: the sum over all earlier rows (of the same `by`) in the given order.

    Rows are range-partitioned by (by, order) and stored, so that each keeps
    its partition; totals of the partitions (one small row each) are summed
    up, and each partition adds its own running sum. No group, however large,
    meets in one task.
    """
    by = by or []
    spread = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in by], *order).withColumn("_part", F.spark_partition_id())
    spread = save(spread, "running")
    totals = spread.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    above = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *by, *[F.coalesce(F.sum(f"_{v}").over(above), F.lit(0)).alias(f"_base_{v}") for v in values])
    base = base.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], *[f"_base_{v}" for v in values])
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = spread.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    joined = rows.join(base, same)
    return joined.select(*df.columns, *[(F.col(f"_base_{v}") + F.col(f"_in_{v}")).alias(f"{v}_before") for v in values])
