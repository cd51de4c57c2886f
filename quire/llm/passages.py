"""Substring dedup: lines cut into units, unit digests grouped globally, earliest occurrences kept."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quire.llm.store import discard, save
from quire.llm.words import byte_words, mixed, slices

#: A repeated run of units goes if it has this many words; shorter phrases stay.
MIN_WORDS = 20
#: A word whose hash is the least among so many neighbours on both sides ends a unit.
REACH = 3

_NEWLINE = 10
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


class Units(NamedTuple):
    text: np.ndarray  # number of the text in the slice
    start: np.ndarray  # first byte, counted from the start of its text
    end: np.ndarray  # byte after the last one; white space behind a unit belongs to it
    words: np.ndarray


class Chains(NamedTuple):
    """Runs of units that are compared, in order of their place."""

    text: np.ndarray
    start: np.ndarray  # number of the first unit
    stop: np.ndarray  # number of the unit behind the last one
    digest: np.ndarray


def cut_chains(texts: list[bytes], min_words: int = MIN_WORDS) -> tuple[Units, Chains]:
    """Units of lines and sentences, and the chains of them that are compared.

    A unit also ends behind a word whose hash is the least within REACH words,
    which falls alike in every copy of a passage, in any script and without marks.

    Chains: every unit with its next units up to `min_words` words or more; the last
    such start of a text, and of each line, with all units to the end of it, so that
    nothing of an equal text or line lies under no chain; and a text of fewer words as a whole.
    A digest covers the words of the whole chain in lower case and their order,
    not the units they fall into. Capitals cut nothing, so text in capitals has units as other text has.
    """
    data, first, last, hashes = byte_words(texts)
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    none = np.zeros(0, np.int64)
    if not len(first):
        return Units(none, none, none, none), Chains(none, none, none, none)
    lines = np.cumsum(data == _NEWLINE)
    owner = np.searchsorted(base, first, side="right") - 1
    least = np.ones(len(first), bool)
    for k in range(1, REACH + 1):
        apart = owner[k:] != owner[:-k]  # words of another text in the slice must not count
        least[:-k] &= apart | (hashes[:-k] < hashes[k:])
        least[k:] &= apart | (hashes[k:] <= hashes[:-k])
    new = np.append(True, (lines[first[1:]] > lines[last[:-1] - 1]) | _ENDS[data[last[:-1] - 1]] | least[:-1])
    at = np.flatnonzero(new)
    behind = np.append(at[1:], len(first))
    text = owner[at]
    follows = np.append(text[1:] == text[:-1], False)
    end = np.where(follows, np.append(first[at][1:], 0), base[text + 1] - 1)

    unit = np.arange(len(at))
    final = np.searchsorted(behind, at + min_words)
    whole = final < len(at)
    whole[whole] = text[final[whole]] == text[whole]
    starts, stops = [unit[whole]], [final[whole] + 1]
    # numbers of texts and lines ascend with the units, so each is a run of them
    for group in (text, lines[first[at]]):
        stop = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        begin = np.append(0, stop[:-1])
        # the last unit from which there are enough words to the end of the run
        start = np.searchsorted(at, behind[stop - 1] - min_words, side="right") - 1
        long = start >= begin
        starts.append(start[long])
        stops.append(stop[long])
        if group is text:
            starts.append(begin[~long])
            stops.append(stop[~long])
    # in order of their place; an end that a unit's own chain reaches, or that a line and its text share, is one chain
    start, stop = np.divmod(np.unique(np.concatenate(starts) * (len(at) + 1) + np.concatenate(stops)), len(at) + 1)

    powers, inverse = np.full(len(first), _FACTOR), np.full(len(first), _INVERSE)
    powers[0] = inverse[0] = 1
    sums = np.append(np.uint64(0), np.cumsum(hashes * np.cumprod(powers)))
    size = behind[stop - 1] - at[start]
    digest = mixed((sums[at[start] + size] - sums[at[start]]) * np.cumprod(inverse)[at[start]] + size.astype(np.uint64)).view(np.int64)
    return Units(text, first[at] - base[text], end - base[text], behind - at), Chains(text[start], start, stop, digest)


def chain_digests(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, row (a hash of id and text), digests of all chains in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                _, chains = cut_chains(texts, min_words)
                edges = np.searchsorted(chains.text, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(chains.digest, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "row", "digests"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    return columns.mapInArrow(rows, "doc_id long, row long, digests array<long>")


def repeated_chains(units: DataFrame) -> DataFrame:
    """row, places: the chains of each text that occurred before, ranked by (doc_id, row, place).

    `places` has their place and, if the earliest one is in the same text, its place as `back` (else null).

    Digests alone are counted first, so a passage of millions of documents is one
    small row per task there; only places of digests that repeat are stored, ranked
    and joined. Both lists of digests are stored first, so that the joins can split a
    common digest. The table of digests is removed.
    """
    rank = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "row", "place")
    places = units.select("doc_id", "row", F.posexplode("digests").alias("place", "digest"))
    twice = save(places.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "twice")
    places = save(places.join(twice, "digest").select("doc_id", "row", "place", "digest"), "places")
    discard(units)
    groups = places.groupBy("digest").agg(F.min(rank).alias("first"))
    groups = save(groups.select("digest", F.col("first.row").alias("_row"), F.col("first.place").alias("_place")), "groups")
    again = places.select("row", "place", "digest").join(groups, "digest").where("row <> _row or place <> _place")
    back = F.when(F.col("row") == F.col("_row"), F.col("_place")).alias("back")
    return again.groupBy("row").agg(F.collect_set(F.struct("place", back)).alias("places"))


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of `docs`, texts without their repeated passages, and what was removed.

    Adds `removed` (spans: first and end code point in the original text),
    `n_units` and `removed_words`. Only words that follow one another as they did before
    count as repeated: of equal chains (see cut_chains) everywhere the one with the
    smallest (doc_id, place) stays, and units go that lie under another one. So the words of
    an equal text, or of an equal line of `min_words` words or more, go altogether; white space in front of
    the first word stays. In one text, a chain that overlaps its earliest copy stays.
    Lines and passages of fewer words stay, unless they are all of a text that is repeated.

    Rows that repeat both id and text count as one document, null ids rank last,
    null texts stay null, extra columns are passed on (columns named like the added ones are replaced).
    """
    repeats = save(repeated_chains(save(chain_digests(docs, min_words), "chains")), "repeats").withColumnRenamed("row", "_row")
    kept = [c for c in docs.columns if c not in ("removed", "n_units", "removed_words")]
    joined = docs.select(*kept, F.xxhash64(F.col("doc_id"), F.col("text")).alias("_key")).join(repeats, F.col("_key") == F.col("_row"), "left")
    schema = docs.select(*kept).schema
    text_at = kept.index("text")

    def repeated(texts: list[bytes], places: pa.Array) -> tuple[Units, np.ndarray, np.ndarray]:
        """All units of some texts, the first of each text, which ones go."""
        units, chains = cut_chains(texts, min_words)
        first = np.searchsorted(chains.text, np.arange(len(texts) + 1))
        change = np.zeros(len(units.text) + 1, np.int64)
        for i in range(len(texts)):
            for x in places[i].as_py() or ():
                c = first[i] + x["place"]
                if x["back"] is None or chains.stop[first[i] + x["back"]] <= chains.start[c]:
                    change[chains.start[c]] += 1
                    change[chains.stop[c]] -= 1
        return units, np.searchsorted(units.text, np.arange(len(texts) + 1)), np.cumsum(change)[:-1] > 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                units, edges, gone = repeated(texts, part.column(len(kept)))
                out, spans, lost = [], [], []
                nulls = part.column(text_at).is_null().to_pylist()
                for i, text in enumerate(texts):
                    own = np.arange(edges[i], edges[i + 1])[gone[edges[i] : edges[i + 1]]]
                    if not len(own):
                        out.append(None if nulls[i] else text.decode())
                        spans.append([])
                        lost.append(0)
                        continue
                    cut, at, pieces, marks = own[np.append(True, np.diff(own) > 1)], 0, [], []
                    stop = own[np.append(np.diff(own) > 1, True)]
                    for a, b in zip(units.start[cut].tolist(), units.end[stop].tolist()):
                        pieces.append(text[at:a])
                        marks.append((a, b))
                        at = b
                    pieces.append(text[at:])
                    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    out.append(b"".join(pieces).decode())
                    spans.append([{"start": int(points[a]) - 1, "end": int(points[b - 1])} for a, b in marks])
                    lost.append(int(units.words[own].sum()))
                columns = [pa.array(out, pa.string()) if k == text_at else part.column(k) for k in range(len(kept))]
                added = [pa.array(spans, span), pa.array(np.diff(edges), pa.int64()), pa.array(lost, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *added], [*kept, "removed", "n_units", "removed_words"])

    spans_type = ArrayType(StructType().add("start", "integer").add("end", "integer"))
    result = StructType(list(schema)).add("removed", spans_type).add("n_units", "long").add("removed_words", "long")
    return joined.select(*kept, "places").mapInArrow(rows, result)
