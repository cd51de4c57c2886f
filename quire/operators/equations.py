"""Equations of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import mathematics as M
from quire.functions import text as T

BOX = ["x0", "y0", "x1", "y1"]
_FIELDS = ["source_order", "match_pos", "key", "raw_text", "latex", "is_inline", "variables"]


def _places(content: Column, etype: Column, entry: Callable[..., Column], kind: str) -> Column:
    """An array with what ``entry`` keeps, of SQL type ``kind``, of every place of a block an equation may be read from."""
    text = T.strip(content)
    tagged = etype == "equation"

    def matches(order, pattern, body, inline):
        return F.transform(
            F.regexp_extract_all(content, F.lit(pattern), F.lit(0)),
            lambda m, i: entry(order, i, T.strip(body(m)), T.strip(m), T.strip(body(m)), F.lit(inline), M.variables(body(m))),
        )

    # both patterns need one of these, and most blocks have neither
    marked = F.contains(content, F.lit("$")) | F.contains(content, F.lit("\\begin{"))
    nothing = F.array().cast(f"array<{kind}>")
    own = entry(0, F.lit(0), M.strip_label(text), M.strip_label(text), M.tagged_latex(text), F.lit(False), M.variables(text))
    heuristic = entry(3, F.lit(0), text, text, M.clean_to_latex(text), F.length(text) < 80, M.variables(text))
    return F.when(tagged & (F.length(text) > 0), F.array(own)).when(
        ~tagged,
        F.concat(
            F.when(marked, F.concat(matches(1, fixed.DISPLAY_MATH, M.display_body, False), matches(2, fixed.INLINE_MATH, M.inline_body, True))).otherwise(nothing),
            F.when(
                (etype == "paragraph") & (F.length(content) < fixed.HEURISTIC_MAX_CHARS)
                & M.may_be_math(content) & (M.math_score(content) >= fixed.MIN_MATH_SCORE),
                F.array(heuristic),
            ).otherwise(nothing),
        ),
    )


def equation_keys(content: Column, etype: Column) -> Column:
    """The texts of a block's equations; a document has as many equations as its blocks have different ones."""
    return _places(content, etype, lambda order, match_pos, key, *rest: key, "string")


def equation_candidates(elements: DataFrame) -> DataFrame:
    """Every place an equation may be read from, before duplicates are removed.

    Each carries the box of its element. Blocks typed as equations; display and inline LaTeX in all other blocks; and
    short paragraphs that score as mathematics. One pass, nothing leaves the row.
    """

    def entry(order, match_pos, key, raw, latex, inline, variables):
        return F.struct(
            F.lit(order).alias("source_order"), match_pos.alias("match_pos"), key.alias("key"), raw.alias("raw_text"),
            latex.alias("latex"), inline.alias("is_inline"), variables.alias("variables"),
        )

    found = _places(
        F.col("content"), F.col("element_type"), entry,
        "struct<source_order:int,match_pos:int,key:string,raw_text:string,latex:string,is_inline:boolean,variables:array<string>>",
    )
    box = [(F.col(c) if c in elements.columns else F.lit(None)).cast("double").alias(c) for c in BOX]
    return elements.select("doc_id", "pos", "page_number", *box, F.explode_outer(found).alias("m")).where("m is not null").select(
        "doc_id", "pos", "page_number", *BOX, *[f"m.{c}" for c in _FIELDS]
    )


def dedupe_equations(candidates: DataFrame) -> DataFrame:
    """First occurrence of each equation text in a document; aggregates map-side, so repeats are cheap."""
    order = F.struct("pos", "source_order", "match_pos")
    rest = F.struct("page_number", *BOX, "raw_text", "latex", "is_inline", "variables")
    return (
        candidates.groupBy("doc_id", "key")
        .agg(F.min(order).alias("o"), F.min_by(rest, order).alias("e"))
        .select(
            F.concat_ws(":", "doc_id", F.lit("eq"), "o.pos", "o.source_order", "o.match_pos").alias("equation_id"),
            "doc_id", F.col("o.pos").alias("pos"), F.col("o.source_order").alias("source_order"),
            F.col("o.match_pos").alias("match_pos"), "e.*",
        )
    )


def extract_equations(elements: DataFrame) -> DataFrame:
    return dedupe_equations(equation_candidates(elements))
