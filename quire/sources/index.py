"""The chunk index as a table: saved, loaded, merged and pruned; and rewriting of bucketed tables in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import prepared, scratch_path

#: Rows of a bucket, as a target; the number of buckets is fixed when a table is first written.
BUCKET_ROWS = 20_000
_COUNT_FILE = "_buckets"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets the table has; None if there is no bucketed table."""
    store, target = _path(spark, f"{path}/{_COUNT_FILE}")
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return stream.readInt()
    finally:
        stream.close()


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write_buckets(placed: DataFrame, path: str, fmt: str, bucket: str) -> None:
    """Rows that lie together by bucket already, into few files for each; texts are compressed, so a file of them is read by one task."""
    most, packed = (BUCKET_ROWS, {"compression": "gzip"}) if fmt == "json" else (50 * BUCKET_ROWS, {})
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", most).options(**packed).partitionBy(
        bucket
    ).format(fmt).save(path)


def create_bucketed(rows: DataFrame, path: str, fmt: str, key: str, bucket: str) -> str:
    """Write a new table; the number of buckets follows from its rows and is stored with it."""
    spark = rows.sparkSession
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    # a bucket is written by one task, or by several if it is large
    _write_buckets(rows.withColumn(bucket, bucket_of(key, buckets)).repartition(F.col(bucket)), path, fmt, bucket)
    store, target = _path(spark, f"{path}/{_COUNT_FILE}")
    stream = store.create(target, True)
    stream.writeInt(buckets)
    stream.close()
    return path


@prepared
def change_bucketed(
    spark: SparkSession, path: str, fmt: str, key: str, bucket: str, old: DataFrame, keys: DataFrame, new: DataFrame | None = None
) -> None:
    """Remove the rows with the given keys from the stored table and add new ones.

    Only the buckets of those keys are read and rewritten; their other rows stay.
    Rows and keys are brought together by bucket, once, whatever number of keys there is. The rewritten buckets are staged first,
    because a table cannot be read and overwritten at once; they are staged by bucket, so that writing them does not deal
    them out again, and the staged ones are removed after. Buckets that keep no row are removed before the others are overwritten: after
    a failure the table lacks nothing but rows that were to go, and the change can be made again.
    ``old`` is the table as read from ``path``.
    """
    buckets = stored_buckets(spark, path)
    wanted = keys.select(F.col(key).cast("string").alias("_key")).distinct()
    wanted = wanted.select("_key", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int").alias(bucket))
    touched = wanted.select(bucket).distinct()
    kept = old.join(F.broadcast(touched), bucket, "left_semi")
    rows = kept.withColumns({"_key": F.col(key).cast("string"), "_side": F.lit(0)}).unionByName(wanted.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    if new is not None:
        fresh = new.withColumns({bucket: bucket_of(key, buckets), "_key": F.col(key).cast("string"), "_side": F.lit(2)})
        rows = rows.unionByName(fresh, allowMissingColumns=True)
    # of stored rows those with a null key never go
    gone = F.max(F.col("_side") == 1).over(Window.partitionBy(bucket, "_key")) & F.col("_key").isNotNull()
    rows = rows.repartition(F.col(bucket)).withColumn("_gone", gone).where("_side = 2 or _side = 0 and not _gone").drop("_key", "_side", "_gone")
    path_staged = scratch_path(spark, "staged")
    rows.write.partitionBy(bucket).parquet(path_staged)
    staged = spark.read.schema(rows.schema).parquet(path_staged)
    emptied = touched.join(staged.select(bucket).distinct(), bucket, "left_anti")
    for row in emptied.toLocalIterator():
        store, target = _path(spark, f"{path}/{bucket}={row[0]}")
        store.delete(target, True)
    _write_buckets(staged, path, fmt, bucket)
    store, target = _path(spark, path_staged)
    store.delete(target, True)


def persist_index(chunks: DataFrame, path: str, partitioned: bool = False) -> str:
    """Save an index; with ``partitioned`` by document bucket, so deletes and merges rewrite few files."""
    if partitioned:
        return create_bucketed(chunks, path, "parquet", "doc_id", "doc_bucket")
    # a dictionary of weights only costs time: hardly any but zero comes twice
    chunks.write.mode("overwrite").option("parquet.enable.dictionary#embedding.list.element", "false").parquet(path)
    return path


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert_chunks(index: DataFrame, new: DataFrame, append: bool = False, id_col: str = "chunk_id", order_col: str | None = None) -> DataFrame:
    """Index with new chunks merged in by id; chunks without a vector are ignored.

    Of new chunks of one id the last by ``order_col`` is taken (without it, one that
    depends on the rows alone). With ``append`` nothing is replaced and duplicates may arise.
    """
    usable = new.where(F.col("embedding").isNotNull())
    if append:
        return index.unionByName(usable, allowMissingColumns=True)
    order = [F.desc_nulls_last(order_col)] if order_col else []
    last = Window.partitionBy(id_col).orderBy(*order, F.xxhash64(*[F.col(c) for c, kind in usable.dtypes if not kind.startswith("map")]))
    latest = usable.withColumn("_place", F.row_number().over(last)).where(F.col("_place") == 1).drop("_place")
    return index.join(latest.select(id_col), id_col, "left_anti").unionByName(latest, allowMissingColumns=True)


def delete_documents(index: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Index without the rows of the given documents."""
    return index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def delete_stored(spark: SparkSession, path: str, doc_ids: DataFrame) -> None:
    """Remove the given documents from a partitioned index on disk."""
    change_bucketed(spark, path, "parquet", "doc_id", "doc_bucket", load_index(spark, path), doc_ids)


def upsert_stored(spark: SparkSession, path: str, new: DataFrame, order_col: str | None = None) -> None:
    """Merge whole documents into a partitioned index on disk: their stored chunks go, the new ones with a vector stay."""
    chunks = upsert_chunks(load_index(spark, path).limit(0).drop("doc_bucket"), new, order_col=order_col)
    change_bucketed(spark, path, "parquet", "doc_id", "doc_bucket", load_index(spark, path), new, chunks)
