"""Document lists, user libraries, chat messages, status and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T
from quire.operators import chunking, citations, equations, scans
from quire.session import prepared


def list_documents(active: DataFrame, saved: DataFrame) -> DataFrame:
    """Active documents before saved ones, test uploads dropped, first document of each title.

    Inputs: doc_id, title, filename, authors (array), pos (list order). The first
    per title is a map-side aggregated minimum, so a very common title costs nothing.
    """

    def named(df: DataFrame, rank: int, status: str) -> DataFrame:
        title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("filename"), F.lit("")), F.lit(fixed.DEFAULT_TITLE))
        return df.select("doc_id", title.alias("title"), "authors", F.lit(rank).alias("rank"), "pos", F.lit(status).alias("status"))

    every = named(active, 0, "Active").unionByName(named(saved, 1, "Saved"))
    low = F.lower("title")
    test = F.contains(F.lower(F.col("doc_id").cast("string")), F.lit(fixed.TEST_TITLE_MARKS[0])) | T.any_of(low, fixed.TEST_TITLE_MARKS)
    clean = T.strip(F.col("title"))
    return (
        every.where(~test).withColumn("title", clean).where(F.length("title") > 0)
        .groupBy("title")
        .agg(F.min_by(F.struct("doc_id", "authors", "status"), F.struct("rank", "pos")).alias("d"))
        .select(
            "d.doc_id", "title",
            F.when(F.size("d.authors") > 0, F.array_join("d.authors", ", ")).otherwise(
                F.when(F.col("d.status") == "Active", F.lit("")).otherwise(F.lit(fixed.DEFAULT_AUTHORS))).alias("authors"),
            F.col("d.status").alias("timestamp"),
        )
    )


def user_documents(library: DataFrame, user_id: int | str | None = None) -> DataFrame:
    """Documents of a user (or of every user), newest first. A range sort, so one user may own most rows."""
    own = library if user_id is None else library.where(F.col("user_id") == user_id)
    return own.select(
        "user_id", F.col("doc_id").alias("id"), "title", "authors", "filename", F.col("created_at").alias("timestamp")
    ).orderBy("user_id", F.desc("timestamp"), "id")


def add_user_documents(library: DataFrame, new: DataFrame) -> DataFrame:
    """Library with new (user, document) rows; pairs that are already there are left alone."""
    first = new.groupBy("user_id", "doc_id").agg(
        F.min_by(F.struct(*[c for c in new.columns if c not in ("user_id", "doc_id")]), F.col("created_at")).alias("r")
    ).select("user_id", "doc_id", "r.*")
    return library.unionByName(first.join(library.select("user_id", "doc_id"), ["user_id", "doc_id"], "left_anti"))


def save_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages with new ones appended; citations are kept as JSON, `[]` when there are none."""
    citations = F.coalesce(F.to_json("citations"), F.lit("[]")) if "citations" in new.columns else F.lit("[]")
    kept = new.withColumn("citations_json", citations).drop("citations")
    return messages.unionByName(kept.select(*messages.columns))


def chat_history(messages: DataFrame, user_id: int | str | None = None, doc_id: int | str | None = None) -> DataFrame:
    """Messages of one user and document (or all), oldest first."""
    own = messages
    if user_id is not None:
        own = own.where(F.col("user_id") == user_id)
    if doc_id is not None:
        own = own.where(F.col("doc_id") == doc_id)
    return own.orderBy("user_id", "doc_id", "created_at", "id").select(
        "user_id", "doc_id", "id", "role", "content", "citations_json", F.col("created_at").alias("timestamp")
    )


def ingest_status(documents: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """completed, or failed with the message of the first failing check. No row stops the job."""
    message = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()])
    return documents.withColumn("error_message", message).withColumn(
        "status", F.when(F.col("error_message").isNull(), "completed").otherwise("failed")
    )


def element_marks(elements: DataFrame) -> DataFrame:
    """What counts need of every element, without its text: the texts are read and searched once."""
    content, etype, text = F.col("content"), F.col("element_type"), F.col("_text")
    tokens, parts = chunking.chunk_sizes(text, etype)
    return elements.select("doc_id", "pos", "page_number", "element_type", "content", T.strip(content).alias("_text")).select(
        "doc_id", "pos", "page_number", "element_type",
        citations.n_citations(content, etype).alias("n_citations"),
        equations.equation_keys(content, etype).alias("equation_keys"),
        citations.is_named_header(text).alias("is_named"), (F.length(text) >= 10).alias("is_entry"),
        tokens.cast("int").alias("tokens"), parts.cast("int").alias("parts"),
    )


def element_blocks(marks: DataFrame, block: int = scans.BLOCK) -> DataFrame:
    """Marks by runs of positions: numbers of elements, citations and split chunks, and what packing and bibliographies need in order."""
    etype, pos = F.col("element_type"), F.col("pos")
    item = F.struct("pos", "tokens", F.coalesce("is_entry", F.lit(False)).alias("entry"), F.coalesce(etype.isin(fixed.REFERENCE_STOP_TYPES), F.lit(False)).alias("stop"))
    return marks.groupBy("doc_id", scans.pos_block("pos", block).alias("blk")).agg(
        F.count("*").alias("elements"), F.sum("n_citations").alias("citations"), F.sum("parts").alias("parts"), F.max("pos").alias("last_pos"),
        F.min(F.when(etype == "references", pos)).alias("typed"), F.min(F.when(F.col("is_named"), pos)).alias("named"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )


def count_equations(marks: DataFrame) -> DataFrame:
    """One row for each equation of a document."""
    return marks.where(F.size("equation_keys") > 0).select("doc_id", F.explode("equation_keys").alias("key")).distinct()


def _number(frame: DataFrame) -> Column:
    return (F.col("n") if "n" in frame.columns else F.lit(1)).cast("bigint").alias("n")


def _counted(base: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Counts of every kind of child in one grouping: a tag for each child row, one aggregate, one join.

    A row stands for one child, or for ``n`` where it has that column.
    """
    tags = [frame.select("doc_id", F.lit(name).alias("_kind"), _number(frame)) for name, frame in children.items()]
    counts = reduce(DataFrame.unionByName, tags).groupBy("doc_id").agg(*[F.sum(F.when(F.col("_kind") == name, F.col("n")).otherwise(0)).alias(name) for name in children])
    joined = base.join(counts, "doc_id", "left")
    return joined.select(*[c for c in base.columns if c not in children], *[F.coalesce(n, F.lit(0)).alias(n) for n in children])


@prepared
def processing_stats(metadata: DataFrame, ocr_pages: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Per document: total, recognised and digital pages, mean recognition confidence, and counts of each child."""
    ocr = ocr_pages.groupBy("doc_id").agg(F.count("*").alias("ocr_pages"), F.avg("mean_confidence").alias("conf"))
    base = metadata.select("doc_id", F.col("page_count").alias("total_pages")).join(ocr, "doc_id", "left").select(
        "doc_id", "total_pages", F.coalesce("ocr_pages", F.lit(0)).alias("ocr_pages"),
        (F.col("total_pages") - F.coalesce("ocr_pages", F.lit(0))).alias("digital_pages"),
        F.coalesce("conf", F.lit(1.0)).alias("ocr_mean_confidence"),
    )
    return _counted(base, children)


@prepared
def document_summary(metadata: DataFrame, status: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """One row per document: title, authors, pages, status and child counts."""
    base = metadata.select("doc_id", "filename", "title", F.array_join("authors", ", ").alias("authors"), "page_count").join(
        status.select("doc_id", "status"), "doc_id", "left"
    )
    return _counted(base, children)


def corpus_analytics(metadata: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document and for the corpus (doc_id null): pages, reading minutes, chunks by type and their shares."""
    kinds = {"text": ["text", "abstract"], "table": ["table"], "figure": ["figure"], "equation": ["equation"]}
    by_doc = chunks.select("doc_id", "chunk_type", _number(chunks)).groupBy("doc_id").agg(*[
        F.sum(F.when(F.col("chunk_type").isin(types), F.col("n")).otherwise(0)).alias(f"n_{k}") for k, types in kinds.items()
    ])
    counts = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds]
    rows = metadata.select("doc_id", "page_count").join(by_doc, "doc_id", "left").select("doc_id", "page_count", *counts)
    rolled = rows.rollup("doc_id").agg(F.sum("page_count").alias("pages"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])
    n = sum((F.col(f"n_{k}") for k in kinds), F.lit(0))
    shares = [F.when(n > 0, F.round(F.col(f"n_{k}") / n, 6)).otherwise(0.0).alias(f"share_{k}") for k in kinds]
    return rolled.select(
        "doc_id", "pages", (F.col("pages") * 2).alias("reading_minutes"), n.alias("n_chunks"),
        (F.col("n_table") + F.col("n_figure")).alias("n_tables_figures"), "n_equation", *shares,
    )
