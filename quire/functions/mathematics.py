"""Column expressions that recognise and clean equations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T


#: Every match of a pattern of math_score holds one of these; one range takes in all signs and Greek letters, as a long list is slow.
_MATH_CHARACTER = r"[=<>±\\(_\^\x{100}-\x{10FFFF}]"
_MATH_SIGN = r"[=<>±\\_\^\x{100}-\x{10FFFF}]"


def clean_to_latex(text: Column) -> Column:
    out = T.strip(text)
    out = F.regexp_replace(out, r"^\$\$(?U:\s*)", "")
    out = F.regexp_replace(out, r"(?U:\s*)\$\$\z", "")
    for plain, latex in fixed.LATEX_REPLACEMENTS:
        out = F.replace(out, F.lit(plain), F.lit(latex))
    return out


def strip_label(content: Column) -> Column:
    """Content without a trailing equation number such as (1), (2.3) or (A1)."""
    return F.when(
        content.rlike(fixed.EQUATION_LABEL), T.strip(F.regexp_replace(content, fixed.EQUATION_LABEL, ""))
    ).otherwise(content)


def label_of(content: Column) -> Column:
    return F.nullif(T.strip(F.regexp_extract(content, fixed.EQUATION_LABEL, 0)), F.lit(""))


def display_body(match: Column) -> Column:
    """Inside of a display match: between dollars, or between begin and end."""
    dollars = F.regexp_extract(match, fixed.DISPLAY_MATH, 1)
    return F.when(F.length(dollars) > 0, dollars).otherwise(F.regexp_extract(match, fixed.DISPLAY_MATH, 2))


def inline_body(match: Column) -> Column:
    return F.regexp_extract(match, fixed.INLINE_MATH, 1)


def tagged_latex(content: Column) -> Column:
    """LaTeX of a block already known to be an equation. Takes stripped content."""
    display = F.regexp_extract(content, fixed.DISPLAY_MATH, 0)
    dollars = F.regexp_extract(content, fixed.DISPLAY_MATH, 1)
    inline = inline_body(content)
    return (
        F.when(F.length(dollars) > 0, T.strip(dollars))
        .when(F.length(display) > 0, T.strip(display))
        .when(F.length(inline) > 0, T.strip(inline))
        .otherwise(clean_to_latex(content))
    )


def math_score(text: Column) -> Column:
    """Additive, capped score of how much a text looks like mathematics, in 0..1."""

    def part(pattern: str, weight: float, cap: float) -> Column:
        return F.least(F.lit(cap), F.regexp_count(text, F.lit(pattern)) * F.lit(weight))

    n_operators = F.regexp_count(text, F.lit(fixed.MATH_OPERATOR))
    size = F.length(text)
    score = (
        part(fixed.MATH_OPERATOR, 0.15, 0.4)
        + part(fixed.GREEK_LETTER, 0.1, 0.3)
        + part(fixed.LATEX_COMMAND, 0.15, 0.4)
        + part(fixed.FUNCTION_CALL, 0.05, 0.2)
        + part(fixed.SUB_OR_SUPERSCRIPT, 0.05, 0.2)
        + F.when((size < 100) & (n_operators >= 1), F.lit(0.2)).otherwise(F.lit(0.0))
        - F.when(size > 180, F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when(text.rlike(fixed.EQUATION_LABEL), F.lit(0.25)).otherwise(F.lit(0.0))
    )
    # without any character of the patterns above the score is zero, and most prose has none
    return F.when((size < 3) | ~text.rlike(_MATH_CHARACTER), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def may_be_math(text: Column) -> Column:
    """Whether math_score can reach the least score that counts: calls and a label alone give 0.45, so a bracket is not enough."""
    return text.rlike(_MATH_SIGN)


def variables(text: Column) -> Column:
    """Single-letter names with an optional subscript, first occurrence order, no repeats."""
    names = F.regexp_extract_all(text, F.lit(fixed.VARIABLE), F.lit(1))
    kept = F.filter(names, lambda v: ~F.lower(v).isin(fixed.NOT_VARIABLES) & (F.length(v) <= 10))
    return F.array_distinct(kept)
