"""Reading structured review replies, and the features a review is written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed

REVIEW = (
    "originality_score double, soundness_score double, empirical_rigor_score double, clarity_score double, "
    "overall_decision string, summary string, strengths array<string>, weaknesses array<string>, "
    "questions_for_authors array<string>"
)


def json_object_text(reply: Column) -> Column:
    """Text from the first opening to the last closing brace; null when there is no such span."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def parse_reviews(replies: DataFrame, column: str, fallback: Column | None = None) -> DataFrame:
    """Review records of replies; unreadable ones take the fallback record (or stay null)."""
    text = json_object_text(F.col(column))
    read = F.from_json(text, REVIEW + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = text.isNotNull() & read["_bad"].isNull()
    names = [part.strip().split()[0] for part in REVIEW.replace("array<string>", "array").split(",")]
    record = F.when(good, F.struct(*[read[n].alias(n) for n in names]))
    return replies.withColumn("parsed", good).withColumn("review", record if fallback is None else F.coalesce(record, fallback))


def review_features(
    elements: DataFrame, metadata: DataFrame, tables: DataFrame, figures: DataFrame, equations: DataFrame, references: DataFrame
) -> DataFrame:
    """What a reviewer prompt is built from: first eight headings, first long paragraph, artifact counts.

    The eight headings come from a bounded top-k per document, never from a full list.
    """
    etype = F.col("element_type")
    headings = first_k(elements.where(etype.isin("heading", "subheading")), 8).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("h")
    ).select("doc_id", F.array_join(F.transform("h", lambda x: x["content"]), ", ").alias("sections"))
    lead = elements.where((etype == "paragraph") & (F.length("content") > 50)).groupBy("doc_id").agg(
        F.min_by(F.substring("content", 1, 500), F.col("pos")).alias("snippet")
    )
    out = metadata.select(
        "doc_id", F.coalesce(F.col("title"), F.col("filename"), F.lit("Research Manuscript")).alias("title"),
        F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise(F.lit(fixed.DEFAULT_AUTHORS)).alias("authors"),
        F.col("page_count").alias("total_pages"),
    ).join(headings, "doc_id", "left").join(lead, "doc_id", "left")
    for name, frame in [("tables", tables), ("figures", figures), ("equations", equations), ("references", references)]:
        out = out.join(frame.groupBy("doc_id").agg(F.count("*").alias(f"n_{name}")), "doc_id", "left")
    counts = [F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in ("tables", "figures", "equations", "references")]
    return out.select(
        "doc_id", "title", "authors", "total_pages", F.coalesce("sections", F.lit("")).alias("sections"),
        F.coalesce("snippet", F.lit("No abstract paragraph detected.")).alias("snippet"), *counts,
    )


def first_k(rows: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The first k rows of every document; Spark limits groups before the shuffle."""
    from pyspark.sql import Window

    first = Window.partitionBy("doc_id").orderBy(order)
    return rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k).withColumnRenamed("_k", "k")
