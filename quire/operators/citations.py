"""In-text citations, bibliography entries and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import references as R
from quire.functions import text as T


_KINDS = [
    ("numeric", fixed.NUMERIC_CITATION, "["),
    ("author_year", fixed.AUTHOR_YEAR_CITATION, "("),
    ("inline", fixed.INLINE_CITATION, "("),
]


def n_citations(content: Column, etype: Column) -> Column:
    """How many rows extract_citations gives of an element. Without a kind's bracket no match is looked for."""
    counts = [F.when(F.contains(content, F.lit(bracket)), F.regexp_count(content, F.lit(pattern))).otherwise(0) for _, pattern, bracket in _KINDS]
    return F.when(etype != "references", sum(counts[1:], counts[0])).otherwise(0)


def extract_citations(elements: DataFrame) -> DataFrame:
    """Citations of every element except reference headers: numeric, (Name, year) and Name (year).

    One row per match with 50 characters of context on each side. Everything
    happens inside the row of the element, so there is no shuffle.
    """
    content = F.col("content")

    def tagged(order: int, kind: str, pattern: str) -> Column:
        return F.transform(
            T.match_spans(content, pattern),
            lambda span, i: F.struct(
                F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), i.alias("match_pos"),
                span["start"].alias("start"), span["match"].alias("match"),
            ),
        )

    found = F.concat(*[tagged(i, kind, pattern) for i, (kind, pattern, _) in enumerate(_KINDS)])
    rows = elements.where(F.col("element_type") != "references").select(
        "doc_id", "pos", "page_number", "content", F.explode_outer(found).alias("m")
    ).where("m is not null")
    inline_key = F.concat(
        F.regexp_extract("m.match", fixed.INLINE_CITATION, 1), F.lit(" ("),
        F.regexp_extract("m.match", fixed.INLINE_CITATION, 2), F.lit(")"),
    )
    return rows.select(
        F.concat_ws(":", "doc_id", "pos", "m.kind", "m.match_pos").alias("citation_id"),
        "doc_id", "pos", "m.kind", "m.match_pos", "page_number",
        F.when(F.col("m.kind") == "inline", inline_key).otherwise(F.col("m.match")).alias("cite_key"),
        T.window_around(content, F.col("m.start"), F.length("m.match"), fixed.CITATION_CONTEXT).alias("context"),
    )


def reference_entries(elements: DataFrame) -> DataFrame:
    """Elements between a document's reference header and its next heading, title or appendix.

    The header is the first element typed as such, or else the first whose text
    is the name of a bibliography. Bounds are one narrow row per document.
    """
    etype = F.col("element_type")
    narrow = elements.where(
        etype.isin(["references", *fixed.REFERENCE_STOP_TYPES])
        | F.lower(T.strip(F.col("content"))).isin(fixed.REFERENCE_HEADERS)
    ).select("doc_id", "pos", "element_type", F.lower(T.strip(F.col("content"))).alias("name"))
    starts = (
        narrow.groupBy("doc_id")
        .agg(
            F.min(F.when(etype == "references", F.col("pos"))).alias("typed"),
            F.min(F.when(F.col("name").isin(fixed.REFERENCE_HEADERS), F.col("pos"))).alias("named"),
        )
        .select("doc_id", F.coalesce("typed", "named").alias("start_pos"))
        .where("start_pos is not null")
    )
    stops = (
        narrow.where(etype.isin(fixed.REFERENCE_STOP_TYPES))
        .join(starts, "doc_id")
        .where("pos > start_pos")
        .groupBy("doc_id")
        .agg(F.min("pos").alias("stop_pos"))
    )
    bounds = starts.join(stops, "doc_id", "left")
    return (
        elements.join(bounds, "doc_id")
        .where((F.col("pos") > F.col("start_pos")) & (F.col("stop_pos").isNull() | (F.col("pos") < F.col("stop_pos"))))
        .select("doc_id", "pos", "page_number", T.strip(F.col("content")).alias("raw_text"))
        .where(F.length("raw_text") > 0)
    )


def is_named_header(text: Column) -> Column:
    """Whether a stripped text is the name of a bibliography; longer texts need not be lowered."""
    return (F.length(text) <= max(map(len, fixed.REFERENCE_HEADERS))) & F.lower(text).isin(fixed.REFERENCE_HEADERS)


def count_references(blocks: DataFrame) -> DataFrame:
    """doc_id and n, parts of the number of rows that extract_references gives, of blocks of catalog.element_blocks.

    Entries up to a block's first heading are counted in the block; a document's count ends with its first such block.
    """
    # a window, as a join could send every block to all executors while their table is small on disk
    start = F.coalesce(*[F.min(c).over(Window.partitionBy("doc_id")) for c in ("typed", "named")])
    after = blocks.withColumn("start_pos", start).where("last_pos > start_pos").select(
        "doc_id", "blk", F.filter("items", lambda i: i["pos"] > F.col("start_pos")).alias("items"),
    ).withColumn("stop_pos", F.array_min(F.transform(F.filter("items", lambda i: i["stop"]), lambda i: i["pos"])))
    counted = after.select(
        "doc_id",
        F.struct(
            "blk", F.col("stop_pos").isNotNull().alias("stopped"),
            F.size(F.filter("items", lambda i: i["entry"] & (F.col("stop_pos").isNull() | (i["pos"] < F.col("stop_pos"))))).alias("n"),
        ).alias("b"),
    )
    runs = counted.groupBy("doc_id").agg(F.collect_list("b").alias("run"), F.min(F.when(F.col("b.stopped"), F.col("b.blk"))).alias("end"))
    kept = F.filter("run", lambda b: F.col("end").isNull() | (b["blk"] <= F.col("end")))
    return runs.select("doc_id", F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, b: s + b["n"]).alias("n"))


def extract_references(elements: DataFrame, parity_year: bool = False) -> DataFrame:
    """Parsed bibliography entries: number, authors, title, venue, year, doi, url."""
    return (
        reference_entries(elements)
        .where(F.length("raw_text") >= 10)
        .select(
            F.concat_ws(":", "doc_id", F.lit("ref"), "pos").alias("reference_id"), "doc_id", "pos", "raw_text",
            F.inline_outer(F.array(R.parse_reference(F.col("raw_text"), parity_year))),
        )
    )


def link_citations(citations: DataFrame, references: DataFrame, expand: bool = False) -> DataFrame:
    """Citations with reference_id: `[n]` by entry number, everything else by first author surname.

    Within a document a repeated entry number counts as its last entry, and a
    surname as its first. Lists and ranges such as `[1, 3]` stay unlinked unless
    ``expand`` is set: then a key gives a row (with the number as ref_index) for
    every entry of the document in its ranges, and one without a link for a range that has none. Both lookups are reduced to
    one row per key before the join, so a heavily cited entry only widens the
    citation side, which adaptive execution splits.
    """
    by_number = references.where("ref_index is not null").groupBy("doc_id", "ref_index").agg(
        F.max_by("reference_id", "pos").alias("by_number")
    )
    by_surname = surnames(references).groupBy("doc_id", "surname").agg(F.min_by("reference_id", "pos").alias("by_surname"))
    keyed = citations.withColumn("ref_index", R.key_index(F.col("cite_key")))
    if expand:
        numeric = F.col("kind") == "numeric"
        ranges = citations.select("*", F.explode_outer(F.when(numeric, R.key_ranges(F.col("cite_key")))).alias("_range"))
        entries = by_number.select(F.col("doc_id").alias("_doc"), F.col("ref_index").alias("_entry"))
        inside = (F.col("doc_id") == F.col("_doc")) & F.col("_entry").between(F.col("_range.low"), F.col("_range.high"))
        single = F.when(F.col("_range.low") == F.col("_range.high"), F.col("_range.low"))
        number = F.coalesce("_entry", single, F.when(~numeric, R.key_index(F.col("cite_key"))))
        keyed = ranges.join(entries, inside, "left").select(*citations.columns, number.alias("ref_index")).distinct()
    keyed = keyed.withColumn("surname", F.when(F.col("ref_index").isNull(), R.key_surname(F.col("cite_key"))))
    return (
        keyed.join(by_number, ["doc_id", "ref_index"], "left")
        .join(by_surname, ["doc_id", "surname"], "left")
        .select(*[keyed[c] for c in citations.columns], *([F.col("ref_index")] if expand else []),
                F.coalesce("by_number", "by_surname").alias("reference_id"))
    )


def surnames(references: DataFrame) -> DataFrame:
    """(doc_id, surname, reference_id, pos), one row per author of an entry."""
    return (
        references.select("doc_id", "reference_id", "pos", F.explode("authors").alias("author"))
        .select("doc_id", "reference_id", "pos", R.surname(F.col("author")).alias("surname"))
        .where(F.length("surname") > 0)
    )


def link_author_year(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Name citations only, with the first entry that has an author of that surname. Years are not compared."""
    return link_citations(citations.where(F.col("kind") != "numeric"), references)


def citation_orbits(references: DataFrame, search: str | None = None, limit: int = 12) -> DataFrame:
    """Placement of a document's first references on two rings, prior work inside, derivative outside."""
    chosen = references
    if search and search.strip():
        q = search.lower()
        chosen = references.where(
            F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q))
            | F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(q)))
        )
    order = Window.partitionBy("doc_id").orderBy("pos")
    first = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    n = F.count("*").over(Window.partitionBy("doc_id"))
    idx = F.col("rank") - 1
    half = F.ceil(F.col("n") / 2)
    prior = idx < half
    group_idx = F.when(prior, idx).otherwise(idx - half)
    group_n = F.greatest(F.when(prior, half).otherwise(F.col("n") - half), F.lit(1))
    return first.withColumn("n", n).select(
        "doc_id", idx.alias("idx"), "reference_id",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Extracted Reference #"), F.col("rank"))).alias("title"),
        F.array_join("authors", ", ").alias("authors"),
        F.coalesce(F.col("year").cast("string"), F.lit("2021")).alias("year"),
        F.when(prior, "prior").otherwise("derivative").alias("orbit"),
        ((group_idx * (F.lit(360.0) / group_n) + F.when(prior, 15).otherwise(45)) % 360).alias("angle"),
        F.when(prior, 210).otherwise(330).alias("distance"),
        F.greatest(F.lit(0.65), F.lit(0.95) - idx * F.lit(0.03)).alias("similarity"),
    )
