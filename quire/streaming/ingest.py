"""Incremental ingestion: arriving documents become chunks of every kind, citations and vectors in a merge-on-read index.

The index is a folder of tables, each with a part per batch:

* `chunks`: text, table, figure and equation chunks with their sparse n-gram counts
* `citations`: linked to the references of their document; `references`
* `frequencies`: how many chunks each bucket gains by the batch, less those of documents it replaces
* `manifest`: every document of the batch and its number of chunks, also when it has none

A batch is visible once its manifest is written, which comes last. Of each
document its latest batch counts, so a document sent again replaces what it was,
and one sent again without content disappears. Weights are applied when the
index is read: vectors depend on the documents that are there, not on the
batches they came in. A batch that is tried again replaces its own parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import chunking, citations, embedding, equations, layout
from quire.session import prepare, scratch_path
from quire.sources import raw

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: From documents to their elements and, where the parser finds them, `tables` and `figures`.
Parser = Callable[[DataFrame], dict[str, DataFrame]]


def parse_text(documents: DataFrame) -> dict[str, DataFrame]:
    """Plain text: lines as elements without places on the page."""
    empty = [F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return {"elements": raw.text_to_elements(documents).select("*", *empty)}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(doc_id, batch_id, n_chunks) of every document's latest batch (of those before the given one)."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if before is not None:
        manifest = manifest.where(F.col("batch_id") < before)
    return manifest.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"), F.max_by("n_chunks", "batch_id").alias("n_chunks"))


def _current(spark: SparkSession, path: str, table: str, before: int | None = None) -> DataFrame:
    """The rows of a table that belong to the latest batch of their document."""
    return spark.read.parquet(f"{path}/{table}").join(_latest(spark, path, before), ["doc_id", "batch_id"], "left_semi")


def ingest_batch(documents: DataFrame, batch_id: int, path: str, parse: Parser = parse_text) -> None:
    """One batch into its own parts of the index at `path`."""
    spark = documents.sparkSession

    def put(rows: DataFrame, table: str) -> DataFrame:
        part = f"{path}/{table}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(part)
        return spark.read.schema(rows.schema).parquet(part)

    _remove(spark, f"{path}/manifest/batch_id={batch_id}")
    found = parse(documents)
    scratch = []

    def keep(rows: DataFrame, name: str) -> DataFrame:
        scratch.append(scratch_path(spark, name))
        rows.write.parquet(scratch[-1])
        return spark.read.schema(rows.schema).parquet(scratch[-1])

    # every extractor reads the elements; the batch is parsed once, and captions are looked for once
    elements = keep(found["elements"], "elements")
    if "tables" in found or "figures" in found:
        captions = keep(layout.caption_candidates(elements), "captions")
    kinds = [chunking.pack_chunks(elements)]
    if "tables" in found:
        kinds.append(chunking.table_chunks(layout.pair_table_captions(keep(found["tables"], "tables"), captions)))
    if "figures" in found:
        kinds.append(chunking.figure_chunks(layout.pair_figure_captions(keep(found["figures"], "figures"), captions)))
    formulas = equations.extract_equations(elements).withColumn("explanation", F.lit(None).cast("string"))
    chunks = put(embedding.with_counts(chunking.union_entities(*kinds, chunking.equation_chunks(formulas)), "content"), "chunks")

    references = put(citations.extract_references(elements), "references")
    put(citations.link_citations(citations.extract_citations(elements), references), "citations")

    arrived = documents.select("doc_id").distinct()
    gained = embedding.bucket_frequencies(chunks)
    if _exists(spark, f"{path}/manifest"):
        replaced = _current(spark, path, "chunks", before=batch_id).join(arrived, "doc_id", "left_semi")
        lost = embedding.bucket_frequencies(replaced).withColumn("df", -F.col("df"))
        gained = gained.unionByName(lost).groupBy("bucket").agg(F.sum("df").alias("df"))
    put(gained, "frequencies")

    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    put(arrived.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")), "manifest")
    for made in scratch:
        _remove(spark, made)


def stream_ingest(
    spark: SparkSession, in_path: str, index_path: str, checkpoint: str, parse: Parser = parse_text, schema: str = DOCUMENT_SCHEMA
) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""
    prepare(spark)
    arriving = spark.readStream.schema(schema).parquet(in_path)
    return (
        arriving.writeStream.foreachBatch(lambda df, batch_id: ingest_batch(df, batch_id, index_path, parse))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_documents(spark: SparkSession, index_path: str) -> DataFrame:
    """(doc_id, batch_id, n_chunks) of all documents that have arrived, those without chunks too."""
    return _latest(spark, index_path)


def current_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The index as of now: the chunks of every document's latest batch, with vectors weighted over all of them."""
    visible = spark.read.parquet(f"{index_path}/manifest").select("batch_id").distinct()
    frequencies = spark.read.parquet(f"{index_path}/frequencies").join(visible, "batch_id", "left_semi")
    chunks = _current(spark, index_path, "chunks")
    return embedding.tfidf_vectors(chunks, "content", frequencies).drop("batch_id", "buckets", "counts")


def current_citations(spark: SparkSession, index_path: str) -> DataFrame:
    """The citations of every document's latest batch, linked to its references."""
    return _current(spark, index_path, "citations").drop("batch_id")
