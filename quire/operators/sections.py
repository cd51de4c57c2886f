"""Sections, outline and section tree of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T
from quire.operators import scans


def is_section_header(element_type: Column) -> Column:
    return element_type.isin(fixed.SECTION_TYPES)


def section_level(element_type: Column) -> Column:
    return (
        F.when(element_type.isin("title", "abstract"), F.lit(0))
        .when(element_type == "heading", F.lit(1))
        .otherwise(F.lit(2))
    )


def assign_sections(elements: DataFrame, keep_headers: bool = False, block: str | None = None) -> DataFrame:
    """Text elements with the section they belong to: section, section_level, section_pos.

    A section runs from its header to the next one in list order; text before any
    header is in 'Main' (level 0, position -1). Headers themselves and
    table/figure/equation/margin elements carry no section text. ``block``: see running_last.
    """
    etype = F.col("element_type")
    header = F.struct(
        F.col("pos").alias("pos"), F.col("content").alias("title"), section_level(etype).alias("level")
    )
    placed = scans.running_last(
        elements, ["doc_id"], ["pos"], {"_section": F.when(is_section_header(etype), header)}, block,
    )
    if keep_headers:
        kept = placed.where(~etype.isin(fixed.NON_TEXT_TYPES))
    else:
        kept = placed.where(~etype.isin(fixed.NON_TEXT_TYPES + fixed.SECTION_TYPES))
    return kept.select(
        *elements.columns,
        F.coalesce("_section.title", F.lit("Main")).alias("section"),
        F.coalesce("_section.level", F.lit(0)).alias("section_level"),
        F.coalesce("_section.pos", F.lit(-1)).alias("section_pos"),
    )


def hierarchy_sections(elements: DataFrame) -> DataFrame:
    """Outline: one row per section with its title, type, page, level and number of elements.

    A header is a typed one, or text that starts like a section name or number.
    Content before the first header forms an overview section.
    """
    text = T.strip(F.col("content"))
    etype = F.lower(F.col("element_type"))
    header = (
        is_section_header(etype)
        | text.rlike(fixed.OUTLINE_HEADER)
        | (text.rlike(fixed.OUTLINE_NUMBERED) & (F.length(text) < 80))
    )
    rows = elements.select(
        "doc_id", "pos", "page_number", "element_type", text.alias("title"), header.alias("is_header")
    ).where(F.length("title") > 0)
    placed = scans.running_last(
        rows, ["doc_id"], ["pos"], {"section_pos": F.when(F.col("is_header"), F.col("pos"))}
    ).withColumn("section_pos", F.coalesce("section_pos", F.lit(-1)))
    first = F.min(F.struct("pos", "title", "element_type", "page_number", "is_header"))
    return (
        placed.groupBy("doc_id", "section_pos")
        .agg(first.alias("h"), F.sum(F.when(F.col("is_header"), 0).otherwise(1)).alias("n_elements"))
        .select(
            "doc_id",
            "section_pos",
            F.when(F.col("h.is_header"), F.col("h.title")).otherwise(F.lit(fixed.OUTLINE_OVERVIEW)).alias("title"),
            F.when(F.col("h.is_header"), F.col("h.element_type")).otherwise(F.lit("HEADING")).alias("section_type"),
            F.col("h.page_number").alias("page_number"),
            F.when(F.col("h.is_header") & (F.lower("h.element_type") == "subheading"), 2).otherwise(1).alias("level"),
            "n_elements",
        )
    )


def tree_level(element_type: Column) -> Column:
    chain = reduce(
        lambda acc, kv: acc.when(element_type == kv[0], F.lit(kv[1])),
        fixed.TREE_LEVELS.items(),
        F.when(F.lit(False), F.lit(0)),
    )
    return chain.otherwise(F.lit(3))


def section_tree(elements: DataFrame) -> DataFrame:
    """Parent, ancestors and depth of every element, in (page, reading order).

    The open path above an element is fully described by the latest earlier
    title-, heading- and subheading-level element: an entry is still open when no
    later entry of the same or a higher rank follows it. So three running
    values replace a stack, and depth and subtree membership read off the
    ancestors without recursion. anc0/anc1/anc2 are positions in the sequence
    (structs of page, order, pos); the root has depth 0.
    """
    level = tree_level(F.col("element_type"))
    here = F.struct("page_number", "reading_order", "pos")
    leveled = elements.withColumn("level", level)
    opened = scans.running_last(
        leveled,
        ["doc_id"],
        ["page_number", "reading_order", "pos"],
        {f"_l{k}": F.when(F.col("level") == k, here) for k in (0, 1, 2)},
        block=scans.reading_block(),
        inclusive=False,
    )

    def later(a: str, b: str) -> Column:
        return F.col(b).isNull() | (F.col(a) > F.col(b))

    anc0 = F.when(F.col("level") > 0, F.col("_l0"))
    anc1 = F.when((F.col("level") > 1) & later("_l1", "_l0"), F.col("_l1"))
    anc2 = F.when((F.col("level") > 2) & later("_l2", "_l0") & later("_l2", "_l1"), F.col("_l2"))
    ancestors = opened.select(
        *elements.columns, "level",
        anc0["pos"].alias("anc0"), anc1["pos"].alias("anc1"), anc2["pos"].alias("anc2"),
    )
    count = sum((F.col(c).isNotNull().cast("int") for c in ("anc0", "anc1", "anc2")), F.lit(1))
    return ancestors.withColumn("parent_pos", F.coalesce("anc2", "anc1", "anc0")).withColumn("depth", count)


def tree_depth(tree: DataFrame) -> DataFrame:
    """Number of nodes and greatest depth per document."""
    return tree.groupBy("doc_id").agg(F.count("*").alias("total_nodes"), F.max("depth").alias("max_depth"))


def tree_sections(tree: DataFrame, max_level: int = 2) -> DataFrame:
    """Titled nodes at or above a level. Depth-first order equals reading order."""
    return tree.where(
        (F.col("level") <= max_level) & (F.col("level") <= 2) & (F.length("content") > 0)
    ).select("doc_id", "pos", "page_number", "reading_order", "level", F.col("content").alias("section_title"))


def subtree_members(tree: DataFrame) -> DataFrame:
    """(doc_id, node_pos, member pos) for every node: itself plus all it is an ancestor of."""
    heads = F.array_compact(F.array("pos", "anc0", "anc1", "anc2"))
    return tree.select("*", F.explode(heads).alias("node_pos"))


def tree_subtree(tree: DataFrame) -> DataFrame:
    """Per node: number of elements below and including it, its text length, leaf flag.

    The newline-joined text itself is ``subtree_text``; sizes are what the corpus
    level needs, and they aggregate map-side however large a subtree is.
    """
    return (
        subtree_members(tree)
        .groupBy("doc_id", "node_pos")
        .agg(
            F.count("*").alias("n_elements"),
            (F.sum(F.length("content")) + F.count("*") - 1).alias("n_chars"),
        )
        .withColumn("is_leaf", F.col("n_elements") == 1)
    )


def subtree_text(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements and joined text of the chosen nodes (doc_id, node_pos), one row each."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "pos", "content")))
    return (
        subtree_members(tree)
        .join(nodes.select("doc_id", "node_pos").distinct(), ["doc_id", "node_pos"], "left_semi")
        .groupBy("doc_id", "node_pos")
        .agg(ordered.alias("_m"))
        .select(
            "doc_id",
            "node_pos",
            F.size("_m").alias("n_elements"),
            F.array_join(F.transform("_m", lambda m: m["content"]), "\n").alias("text"),
        )
    )


def flatten_tree(tree: DataFrame) -> DataFrame:
    """All elements of a tree in depth-first order, which is reading order."""
    return tree.orderBy("doc_id", "page_number", "reading_order", "pos")
