"""Column expressions that assign types to blocks, lines, captions and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T


def is_page_number(text: Column) -> Column:
    return (F.length(text) < 6) & text.rlike(r"^\p{Nd}+$")


def element_type(font_size: Column, is_bold: Column, text: Column, page: Column, order: Column) -> Column:
    """Type of a digital text block. The rules are ordered: a bold 14pt 'References' is a heading."""
    lowered = F.lower(text)
    return (
        F.when((font_size > 18.0) & (page == 1) & (order < 3), F.lit("title"))
        .when((font_size > 11.5) & is_bold & (F.length(text) < 120), F.lit("heading"))
        .when((font_size > 10.0) & is_bold & (F.length(text) < 80), F.lit("subheading"))
        .when((page == 1) & F.contains(T.first_chars(lowered, 40), F.lit("abstract")), F.lit("abstract"))
        .when(F.contains(lowered, F.lit("references")) & (F.length(text) < 50), F.lit("references"))
        .when(is_page_number(text), F.lit("page_number"))
        .otherwise(F.lit("paragraph"))
    )


def ocr_line_type(text: Column) -> Column:
    """Type of a recognised line, from its wording and length."""
    lowered = F.lower(text)
    short = F.length(text) < 80
    return (
        F.when(short & F.contains(lowered, F.lit("references")), F.lit("references"))
        .when(short & F.contains(lowered, F.lit("abstract")), F.lit("abstract"))
        .when(short & T.any_of(lowered, ["introduction", "conclusion"]), F.lit("heading"))
        .when(is_page_number(text), F.lit("page_number"))
        .otherwise(F.lit("paragraph"))
    )


def figure_type(caption: Column) -> Column:
    """First figure class whose words occur in the caption; null without a caption or a hit."""
    return F.when(F.length(caption) > 0, T.first_matching(F.lower(caption), fixed.FIGURE_TYPES))


def is_table_caption(text: Column) -> Column:
    """A caption of its own, not a sentence that mentions a table. Takes stripped text."""
    return ~text.rlike(fixed.TABLE_MENTION) & (
        text.rlike(fixed.TABLE_CAPTION) | (text.rlike(fixed.TABLE_START) & (F.length(text) < 160))
    )


def intent(query: Column) -> Column:
    """First intent, in order, with a keyword inside the question (substring match)."""
    return F.coalesce(T.first_matching(F.lower(query), fixed.INTENTS), F.lit(fixed.DEFAULT_INTENT))


def clean_query(query: Column) -> Column:
    """The question without conversational words."""
    return T.strip(F.regexp_replace(query, fixed.QUESTION_STOP_WORDS, " "))


def augment_query(query: Column, intent_: Column) -> Column:
    """Questions about citations are searched with bibliography terms in front."""
    return F.when(intent_ == "citation", F.concat(F.lit(fixed.CITATION_QUESTION_PREFIX), query)).otherwise(query)


def doc_id_from_filename(filename: Column) -> Column:
    """Upload prefix of a file name when it is long enough, otherwise a stable hash of the name."""
    prefix = F.element_at(F.split(filename, "_"), 1)
    has_prefix = F.contains(filename, F.lit("_")) & (F.length(prefix) >= 32)
    return F.when(has_prefix, prefix).otherwise(F.sha2(filename, 256))


def author_list(raw: Column) -> Column:
    """Comma separated names, stripped, blanks dropped."""
    names = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), T.strip)
    return F.filter(names, lambda n: F.length(n) > 0)


def creation_year(raw: Column) -> Column:
    """Year of a 'D:YYYYMMDD...' stamp; null when too short or not a number."""
    return F.when(F.length(raw) >= 6, F.substring(raw, 3, 4).try_cast("int"))
