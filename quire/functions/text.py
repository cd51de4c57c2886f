"""Column expressions over plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda, or after projections are merged, a plain expression is
    evaluated again at every use; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one; none for an empty text."""
    return (
        F.when(F.length(text) == 0, F.lit(0))
        .otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))
        .cast("int")
    )


def estimate_tokens_unfloored(text: Column) -> Column:
    """The provider-side estimate: a quarter of the characters, possibly zero."""
    return F.floor(F.length(text) / 4).cast("int")


def split_sentences(text: Column) -> Column:
    return F.split(text, fixed.SENTENCE_BOUNDARY)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def any_of(text: Column, words: list[str]) -> Column:
    """True when the text holds at least one of the words as a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def first_matching(text: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Label of the first group, in order, with a word inside the text; null when none has."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in groups:
        chain = chain.when(any_of(text, words), F.lit(label))
    return chain


def match_spans(text: Column, pattern: str) -> Column:
    """Every match with its 0-based start: array<struct<start:int,match:string>>.

    The gaps between matches come from splitting by the same pattern, so the
    starts are running sums of gap and match lengths; all of it stays in the JVM.
    """
    empty = F.expr("cast(array() as array<struct<start:int,match:string>>)")

    def walk(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("at"), empty.alias("found")),
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + F.length(p["match"])).alias("at"),
                F.concat(
                    acc["found"],
                    F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["match"].alias("match"))),
                ).alias("found"),
            ),
            lambda acc: acc["found"],
        )

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, empty).otherwise(walk(m)))


def window_around(text: Column, start: Column, length: Column, reach: int) -> Column:
    """The characters around a span, `reach` on each side, stripped."""
    left = F.greatest(F.lit(0), start - reach)
    right = F.least(F.length(text), start + length + reach)
    return strip(F.substr(text, left + 1, right - left))


# Arrays computed from text are unfolded with the *_outer generators throughout: for the plain
# ones the optimizer adds a "not empty" filter below the generator and so computes the array
# up to three times.
