"""Persisted documents: JSON in and out, nested lists as tables, and ChatML rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.sources.index import change_bucketed, create_bucketed, stored_buckets

IM_START, IM_END = "<|im_start|>", "<|im_end|>"


def read_processed_docs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents from JSON, one per file or (``multi_line=False``) one per line; unreadable ones are left out."""
    rows = (
        spark.read.schema(schemas.DOCUMENT + ", _corrupt_record string")
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", not multi_line)
        .json(path)
    )
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record")


def write_processed_docs(docs: DataFrame, path: str, fmt: str = "json") -> str:
    """Documents below ``path`` by id bucket; writing some again replaces those documents and no others."""
    spark = docs.sparkSession
    if stored_buckets(spark, path) is None:
        return create_bucketed(docs, path, fmt, "id", "id_bucket")
    stored = spark.read.schema(schemas.DOCUMENT + ", id_bucket int").format(fmt).load(path)
    change_bucketed(spark, path, fmt, "id", "id_bucket", stored, docs, docs)
    return path


def delete_processed_docs(spark: SparkSession, path: str, ids: DataFrame, fmt: str = "json") -> None:
    """Remove the document records with the given ids (column ``id``)."""
    stored = spark.read.schema(schemas.DOCUMENT + ", id_bucket int").format(fmt).load(path)
    change_bucketed(spark, path, fmt, "id", "id_bucket", stored, ids)


def explode_children(docs: DataFrame, kind: str) -> DataFrame:
    """One row per entry of a document's child list, with the document id and list position."""
    if kind not in schemas.CHILDREN:
        raise ValueError(f"unknown child list: {kind}")
    return docs.select(F.col("id").alias("doc_id"), F.posexplode(F.col(kind)).alias("pos", "child")).select("doc_id", "pos", "child.*")


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(IM_START), role, F.lit("\n"), text, F.lit(IM_END))


def chatml_conversations(conversations: DataFrame) -> DataFrame:
    """One training text per conversation (conv_id, turn, role, text), turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: turn(t["role"], t["text"])), "\n").alias("text")
    )


def chatml_rows(rows: DataFrame, templates: list[dict[str, str]], index: str, system: str, instruction: str) -> DataFrame:
    """Instruction rows: template ``index mod n`` (keys title, abstract, review) as system, user and assistant turns."""
    n = len(templates)
    pick = lambda key: F.element_at(F.array(*[F.lit(t[key]) for t in templates]), (F.pmod(F.col(index), F.lit(n)) + 1).cast("int"))
    user = F.concat(
        F.lit(f"{instruction}\n\nTitle: "), pick("title"), F.lit(" (Sample #"), F.col(index) + 1, F.lit(")\n\nAbstract: "), pick("abstract")
    )
    return rows.select(
        index, F.concat_ws("\n", turn(F.lit("system"), F.lit(system)), turn(F.lit("user"), user), turn(F.lit("assistant"), pick("review"))).alias("text")
    )
