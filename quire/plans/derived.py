"""Structured inputs derived from the base tables.

The base texts hold no citations, captions or bibliographies, so these views
turn every line of every document into a typed element by fixed arithmetic on
ids and positions. They cover whole tables and grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import stored
from quire.sources.tables import table


def _documents(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """The documents below a root, or those given (as by a stream)."""
    return root if isinstance(root, DataFrame) else table(spark, root, "documents")


def lines(spark: SparkSession, root: str) -> DataFrame:
    split = F.split("text", "\n")
    return _documents(spark, root).select(
        "doc_id", F.size(split).alias("n_lines"), F.posexplode_outer(split).alias("pos", "line")
    )


def body_elements(spark: SparkSession, root: str) -> DataFrame:
    doc, pos, line = F.col("doc_id"), F.col("pos"), F.col("line")
    etype = (
        F.when(pos == 0, "title").when(pos % 7 == 1, "heading").when(pos % 13 == 6, "equation")
        .when(pos % 17 == 9, "caption").otherwise("paragraph")
    )
    text = lambda c: c.cast("string")
    content = (
        F.when(pos == 0, line)
        .when(pos % 7 == 1, F.concat(text(F.floor(pos / 7).cast("int") + 1), F.lit(". "), line))
        .when(pos % 13 == 6, F.concat(line, F.lit(" α_{"), text(pos), F.lit("} = ∑ f(x) + x^2 ("), text(pos), F.lit(")")))
        .when(pos % 17 == 9, F.concat(F.lit("Figure "), text(pos), F.lit(": "), line))
        .when((doc + pos) % 3 == 0, F.concat(line, F.lit(" ["), text((doc + pos) % 4 + 1), F.lit("]")))
        .when((doc + pos) % 5 == 1, F.concat(line, F.lit(" Okafor et al. (20"), text(10 + pos % 10), F.lit(")")))
        .when((doc + pos) % 7 == 2, F.concat(line, F.lit(" (Lindqvist, 2019) [1, 3]")))
        .otherwise(line)
    )
    return (
        lines(spark, root)
        .where(F.length(F.trim("line")) > 0)
        .select("doc_id", "pos", _page(pos), _order(pos), etype.alias("element_type"), content.alias("content"))
    )


def _page(pos):
    return (F.floor(pos / 8).cast("int") + 1).alias("page_number")


def _order(pos):
    return (pos % 8).cast("int").alias("reading_order")


def bibliography(spark: SparkSession, root: str) -> DataFrame:
    doc, i = F.col("doc_id"), F.col("i")
    docs = _documents(spark, root).select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), (2 + doc % 2).cast("int"))).alias("i"))
    name = F.when((doc + i) % 3 == 0, "Okafor and Lindqvist").when((doc + i) % 3 == 1, "Marchetti").otherwise("Lindqvist")
    topic = ((doc * 7 + i * 3) % 50).cast("string")
    entry = F.concat(
        F.lit("["), i.cast("string"), F.lit("] "), name, F.lit(". A study of topic "), topic,
        F.lit(". Journal of Tests, "), (1990 + (doc + i) % 30).cast("string"), F.lit(". doi:10.1234/t"), topic,
    )
    pos = F.col("n_lines") + i
    return rows.select(
        "doc_id", pos.alias("pos"), _page(pos), _order(pos),
        F.when(i == 0, "references").otherwise("paragraph").alias("element_type"),
        F.when(i == 0, F.lit("References")).otherwise(entry).alias("content"),
    )


def plain_elements(spark: SparkSession, root: str) -> DataFrame:
    return body_elements(spark, root).unionByName(bibliography(spark, root))


def elements(spark: SparkSession, root: str) -> DataFrame:
    """Body and bibliography elements with boxes and fonts."""
    pos = F.col("pos")
    y0 = ((F.lit(2) + F.col("reading_order") * 12).cast("double") / 100)
    return plain_elements(spark, root).select(
        "*",
        F.lit(0.1).alias("x0"), y0.alias("y0"), F.lit(0.9).alias("x1"),
        F.when(pos % 3 == 0, y0 + 0.07).otherwise(y0 + 0.11).alias("y1"),
        F.when(F.col("element_type") == "title", 20.0).when(F.col("element_type") == "heading", 14.0)
        .when(pos % 16 == 0, 8.0).otherwise(10.0).alias("font_size"),
        F.col("element_type").isin("title", "heading").alias("is_bold"),
    )


def stored_elements(spark: SparkSession, root: str) -> DataFrame:
    """Elements as a table, for queries that start from them many times: documents are parsed once."""
    return stored(elements(spark, root), "elements")


def captioned_pages(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """Pages with a caption, of documents or of elements that were built before."""
    built = isinstance(root, DataFrame) and "element_type" in root.columns
    return (root if built else body_elements(spark, root)).where(F.col("element_type") == "caption").select("doc_id", "page_number").distinct()


def figures(spark: SparkSession, root: str) -> DataFrame:
    y0 = (20 + (F.col("doc_id") + F.col("page_number")) % 3 * 20).cast("double") / 100
    return captioned_pages(spark, root).select(
        "doc_id", F.col("page_number").cast("bigint").alias("pos"), "page_number",
        F.concat(F.lit("f"), "doc_id", F.lit("-"), "page_number").alias("figure_id"),
        F.lit(0.1).alias("x0"), y0.alias("y0"), F.lit(0.9).alias("x1"), (y0 + 0.15).alias("y1"),
        F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("figure_type"),
    )


def tables(spark: SparkSession, root: str) -> DataFrame:
    y0 = (20 + (F.col("doc_id") + F.col("page_number")) % 3 * 20).cast("double") / 100
    return captioned_pages(spark, root).where(F.col("page_number") % 2 == 0).select(
        "doc_id", F.col("page_number").cast("bigint").alias("pos"), "page_number",
        F.concat(F.lit("t"), "doc_id", F.lit("-"), "page_number").alias("table_id"),
        F.lit(0.1).alias("x0"), y0.alias("y0"), F.lit(0.9).alias("x1"), (y0 + 0.15).alias("y1"),
        (2 + F.col("doc_id") % 3).cast("int").alias("rows"), F.lit(3).alias("cols"),
        F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("csv_repr"),
        F.lit(None).cast("string").alias("summary"),
    )


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row per document: title, authors, number of pages, file name."""
    doc = F.col("doc_id")
    split = F.split("text", "\n")
    last = F.size(split) + 2 + doc % 2
    return _documents(spark, root).select(
        "doc_id",
        F.nullif(F.trim(split[0]), F.lit("")).alias("title"),
        F.array(
            F.concat(F.lit("Author A"), F.floor(doc / 5).cast("string")),
            F.concat(F.lit("Author B"), F.floor(doc / 7).cast("string")),
        ).alias("authors"),
        (F.floor(last / 8).cast("int") + 1).alias("page_count"),
        F.concat(F.lit("doc_"), doc.cast("string"), F.lit(".pdf")).alias("filename"),
        "source", "lang", "n_chars",
    )


def words(spark: SparkSession, root: str) -> DataFrame:
    """Recognised words: every element of every document, split at spaces."""
    parts = body_elements(spark, root).select(
        "doc_id", "pos", "page_number", F.posexplode_outer(F.split("content", " ")).alias("k", "word")
    )
    k = F.col("k")
    return parts.select(
        "doc_id", "page_number", F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("pos").alias("line_num"),
        F.col("k").alias("word_num"), F.col("word").alias("text"),
        (40 + k * 60).cast("double").alias("left"), (40 + F.col("pos") * 14 + k % 2).cast("double").alias("top"),
        (6 * F.length("word")).cast("double").alias("width"), F.lit(10.0).alias("height"),
        F.when(k % 11 == 10, F.lit(-1.0)).otherwise((50 + (k * 7 + F.col("doc_id")) % 50).cast("double")).alias("conf"),
    )


def questions(spark: SparkSession, root: str) -> DataFrame:
    item = F.col("item_id")
    word = F.element_at(
        F.array(*[F.lit(w) for w in ["summarize", "table", "figure", "equation", "citation", "compare", "the results", ""]]),
        (item % 8 + 1).cast("int"),
    )
    return table(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(word, F.lit(" "), "text").alias("query")
    )


def answers(spark: SparkSession, root: str) -> DataFrame:
    item = F.col("item_id")
    cited = F.concat(F.lit("Based on [Source "), (item % 4 + 1).cast("string"), F.lit("] and [source"), (item % 3 + 2).cast("string"), F.lit("] "), "text")
    body = F.concat(F.lit('text {"overall_decision": "ACCEPT", "soundness_score": '), (item % 10).cast("string"))
    return table(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(item % 5 == 0, F.col("text")).otherwise(cited).alias("answer"),
        F.when(item % 6 == 0, F.concat(body, F.lit(" tail"))).otherwise(F.concat(body, F.lit("} tail"))).alias("reply"),
    )
