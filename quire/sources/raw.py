"""Plain text and web pages as typed, ordered elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Fixed values of the page format.
_DROPPED = r"(?is)<(script|style|nav)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
_BLOCK = r"(?is)<(h1|p|li)\b[^>]*>(.*?)(?=<(?:/?(?:h1|p|li|ul|ol|div|article|section|footer|body|html))\b|\z)"
_TAG = r"(?s)<[^>]*>"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def text_to_elements(documents: DataFrame, lines_per_page: int = 8) -> DataFrame:
    """One element per non-blank line: first line is the title, all others are paragraphs.

    Pages hold ``lines_per_page`` lines; reading order restarts on each page.
    """
    lines = documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return (
        lines.withColumn("content", T.strip(F.col("line")))
        .where(F.length("content") > 0)
        .select(
            "doc_id",
            "pos",
            (F.floor(F.col("pos") / lines_per_page) + 1).cast("int").alias("page_number"),
            (F.col("pos") % lines_per_page).cast("int").alias("reading_order"),
            F.when(F.col("pos") == 0, F.lit("title")).otherwise(F.lit("paragraph")).alias("element_type"),
            "content",
        )
    )


def html_to_elements(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of web pages, in page order.

    Scripts, styles, navigation and comments are dropped first; a block runs to
    the next block-level tag; tags inside it are removed and entities resolved.
    """
    kept = F.regexp_replace("html", _DROPPED, " ")
    blocks = pages.select("page_id", F.posexplode_outer(F.regexp_extract_all(kept, F.lit(_BLOCK), F.lit(0))).alias("k", "block"))
    text = F.regexp_replace(F.regexp_extract("block", _BLOCK, 2), _TAG, " ")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    tag = F.lower(F.regexp_extract("block", _BLOCK, 1))
    return (
        blocks.select(
            F.col("page_id").alias("doc_id"), F.col("k").alias("pos"), tag.alias("tag"),
            T.strip(F.regexp_replace(text, r"\s+", " ")).alias("content"),
        )
        .where(F.length("content") > 0)
        .select(
            "doc_id", "pos", F.lit(1).alias("page_number"), F.col("pos").alias("reading_order"),
            F.when(F.col("tag") == "h1", "title").when(F.col("tag") == "p", "paragraph").otherwise("unknown").alias("element_type"),
            "content",
        )
    )
