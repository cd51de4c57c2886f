"""Column expressions that read bibliography entries and citation keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T


def _found(text: Column, pattern: str, group: int) -> Column:
    """The first match, or null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def author_names(text: Column) -> Column:
    """Names of an author segment: list prefix removed, split at separators, one-letter names dropped."""
    body = F.regexp_replace(text, r"^\[[0-9]+\](?U:\s*)", "")
    names = F.transform(
        F.split(body, fixed.AUTHOR_SEPARATOR),
        lambda n: F.regexp_replace(T.strip(n), r"\.+$", ""),
    )
    return F.filter(names, lambda n: F.length(n) > 1)


def publication_year(text: Column, parity: bool = False) -> Column:
    """The last full year in the entry.

    With ``parity`` an entry holding several years collapses to 2020 or 1919,
    following the century of the last one, as in the data being replaced.
    """
    years = F.regexp_extract_all(text, F.lit(fixed.YEAR), F.lit(1))
    last = F.try_element_at(years, F.lit(-1)).cast("int")
    if not parity:
        return last
    return F.when(F.size(years) < 2, last).otherwise(F.when(last >= 2000, F.lit(2020)).otherwise(F.lit(1919)))


def parse_reference(entry: Column, parity_year: bool = False) -> Column:
    """One bibliography entry as struct<ref_index,authors,title,venue,year,doi,url>.

    Null for entries under ten characters. A numbered entry keeps its first line only.
    """
    numbered = entry.rlike(fixed.NUMBERED_REFERENCE)
    body = F.when(numbered, T.strip(F.regexp_extract(entry, fixed.NUMBERED_REFERENCE, 2))).otherwise(entry)
    no_names = F.array().cast("array<string>")

    def fields(text: Column, segments: Column) -> Column:
        n = F.size(segments)
        tail = T.strip(F.array_join(F.slice(segments, F.lit(3), F.greatest(n - 2, F.lit(0))), "."))
        tail = F.regexp_replace(F.regexp_replace(tail, fixed.DOI, ""), fixed.URL, "")
        venue = F.regexp_replace(T.strip(tail), r"\.+$", "")
        return F.struct(
            F.when(numbered, F.regexp_extract(entry, fixed.NUMBERED_REFERENCE, 1).try_cast("bigint")).alias("ref_index"),
            F.when(n >= 2, author_names(T.strip(segments[0]))).otherwise(no_names).alias("authors"),
            F.when(n >= 3, T.strip(segments[1])).alias("title"),
            F.when(n >= 3, F.nullif(venue, F.lit(""))).alias("venue"),
            publication_year(text, parity_year).alias("year"),
            _found(text, fixed.DOI, 1).alias("doi"),
            F.coalesce(
                F.concat(F.lit(fixed.ARXIV_URL), _found(text, fixed.ARXIV, 1)),
                F.regexp_replace(_found(text, fixed.URL, 0), r"\.+$", ""),
            ).alias("url"),
        )

    parsed = T.let(body, lambda t: T.let(F.split(t, r"\."), lambda segments: fields(t, segments)))
    return F.when(F.length(entry) >= 10, parsed)


def surname(author: Column) -> Column:
    """Last word of a name, lower case."""
    return F.lower(F.regexp_extract(author, r"(?U)(\S+)\s*$", 1))


def key_surname(cite_key: Column) -> Column:
    """First word of a citation key without brackets and commas, lower case."""
    return F.lower(F.regexp_extract(F.regexp_replace(cite_key, "[(),]", " "), r"(?U)^\s*(\S+)", 1))


def key_index(cite_key: Column) -> Column:
    """Number of a plain `[n]` key; null for lists, ranges and names."""
    return F.nullif(F.regexp_extract(cite_key, r"^\[([0-9]+)\]", 1), F.lit("")).try_cast("bigint")


def key_ranges(cite_key: Column) -> Column:
    """The (low, high) number ranges a numeric key names, without repeats; nothing is written out, however wide a range is."""
    parts = F.regexp_extract_all(cite_key, F.lit(r"([0-9]+(?:(?U:\s*)[–-](?U:\s*)[0-9]+)?)"), F.lit(1))

    def ends(part: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(part, F.lit("([0-9]+)"), F.lit(1)), lambda d: d.try_cast("bigint"))
        first, last = numbers[0], F.element_at(numbers, -1)
        return F.struct(F.least(first, last).alias("low"), F.greatest(first, last).alias("high"))

    return F.array_distinct(F.transform(parts, ends))
