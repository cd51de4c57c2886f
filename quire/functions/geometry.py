"""Column expressions over page geometry. A box is four columns; null x0 means no box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T


def scale_text_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Text blocks: low edges are kept from going below 0, high edges from going above 1."""
    usable = (width > 0) & (height > 0)
    return F.when(
        usable,
        F.struct(
            F.greatest(F.lit(0.0), x0 / width).alias("x0"),
            F.greatest(F.lit(0.0), y0 / height).alias("y0"),
            F.least(F.lit(1.0), x1 / width).alias("x1"),
            F.least(F.lit(1.0), y1 / height).alias("y1"),
        ),
    )


def scale_region_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Figures and tables: every edge is clamped at both ends, high edges stay above zero."""
    usable = (width > 0) & (height > 0)
    low = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    high = lambda v: F.greatest(F.lit(1e-6), F.least(F.lit(1.0), v))
    return F.when(
        usable,
        F.struct(
            low(x0 / width).alias("x0"),
            low(y0 / height).alias("y0"),
            high(x1 / width).alias("x1"),
            high(y1 / height).alias("y1"),
        ),
    )


def percent_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Position and size of a box in percent of the page."""
    return F.struct(
        (x0 * 100).alias("left_pct"),
        (y0 * 100).alias("top_pct"),
        ((x1 - x0) * 100).alias("width_pct"),
        ((y1 - y0) * 100).alias("height_pct"),
    )


def equation_like(content: Column) -> Column:
    """At least two of the five mathematical patterns occur."""
    patterns = [
        fixed.REGION_OPERATOR,
        fixed.REGION_LATEX,
        fixed.REGION_FUNCTION,
        fixed.REGION_ARITHMETIC,
        fixed.REGION_GREEK,
    ]
    hits = sum((content.rlike(p).cast("int") for p in patterns), F.lit(0))
    return (F.length(T.strip(content)) >= 3) & (hits >= 2)


def region_type(element_type: Column, content: Column, y0: Column, y1: Column, font_size: Column) -> Column:
    """Region class of one element: known types, caption text, page margins, mathematics, text."""
    small = F.coalesce((font_size < fixed.MARGIN_FONT) & (font_size != 0), F.lit(False))
    return (
        F.when(element_type.isin(fixed.REGION_BY_TYPE), element_type)
        .when(T.strip(content).rlike(fixed.CAPTION_START), F.lit("caption"))
        .when(F.coalesce(y0 < fixed.HEADER_Y, F.lit(False)) & small, F.lit("header"))
        .when(F.coalesce(y1 > fixed.FOOTER_Y, F.lit(False)) & small, F.lit("footer"))
        .when(equation_like(content), F.lit("equation"))
        .otherwise(F.lit("text"))
    )
