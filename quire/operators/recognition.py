"""Text blocks from styled spans, and lines, pages and grids from recognised words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from quire import fixed
from quire.functions import classify
from quire.functions import text as T
from quire.operators.folds import Step, ordered_fold, running_number
from quire.session import cut_lineage, prepared

LINE = ["doc_id", "page_number", "block_num", "par_num", "line_num"]
#: A CSV field with one of these goes in quotes.
_QUOTED = re.compile('[,"\r\n]')


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """One row per text block: joined text, most frequent size and font, bold and italic.

    Blank spans are ignored. Ties for the most frequent value go to the smallest.
    A block is bold when a span has flag 16, or else when a font name says so;
    italic likewise with flag 2.
    """
    font = F.lower("font")
    bold_name = T.any_of(font, ["bold", "black", "heavy", "semibold"])
    italic_name = T.any_of(font, ["italic", "oblique"])
    parts = F.array_sort(F.collect_list(F.struct("line_num", "span_num", "text")))
    return (
        spans.where(F.length(T.strip(F.col("text"))) > 0)
        .groupBy("doc_id", "page_number", "block_num")
        .agg(
            T.strip(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("content"),
            F.mode("size", True).alias("font_size"),
            F.mode("font", True).alias("font_name"),
            (F.bool_or(F.col("flags").bitwiseAND(16) > 0) | F.bool_or(bold_name)).alias("is_bold"),
            (F.bool_or(F.col("flags").bitwiseAND(2) > 0) | F.bool_or(italic_name)).alias("is_italic"),
        )
    )


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with reading order within their page and element type."""
    order = (F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("block_num")) - 1).alias("reading_order")
    return blocks.select("*", order).withColumn(
        "element_type",
        classify.element_type(F.col("font_size"), F.col("is_bold"), F.col("content"), F.col("page_number"), F.col("reading_order")),
    )


def _scaled_box(page_width: float, page_height: float) -> dict[str, Column]:
    return {
        "x0": F.greatest(F.lit(0.0), F.col("left") / page_width),
        "y0": F.greatest(F.lit(0.0), F.col("top") / page_height),
        "x1": F.least(F.lit(1.0), (F.col("left") + F.col("width")) / page_width),
        "y1": F.least(F.lit(1.0), (F.col("top") + F.col("height")) / page_height),
    }


def _usable() -> Column:
    """Not blank, and with a confidence. A word that begins with a visible ASCII character need not be stripped to see it."""
    return (F.col("text").between("!", "~") | (F.length(T.strip(F.col("text"))) > 0)) & (F.col("conf") >= 0)


def usable_words(words: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Words that are not blank and have a confidence, with confidence in 0..1 and scaled boxes."""
    return words.where(_usable()).select(
        *LINE, "word_num", T.strip(F.col("text")).alias("text"), "conf", (F.col("conf") / 100.0).alias("confidence"),
        *[c.alias(n) for n, c in _scaled_box(page_width, page_height).items()],
    )


def words_to_lines(words: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Lines of recognised text: words from left to right, union of boxes, mean confidence.

    `conf_sum`, the sum of the words' confidences in percent, decides limits: of
    whole confidences it is exact, and no order of adding up changes it.
    """
    usable = words.where(F.col("conf") >= 0)
    sums = StructType([*usable.select(*LINE).schema.fields, *(StructType().add("text", StringType()).add("confidence", DoubleType()).add("conf_sum", DoubleType()).add("n_words", LongType())).fields])
    for c in ("x0", "y0", "x1", "y1"):
        sums.add(c, DoubleType())
    runs = StructType([*sums.fields]).add("_at", ArrayType(DoubleType())).add("_num", ArrayType(LongType())).add("_size", ArrayType(IntegerType()))
    boxes = [c.cast("double").alias(n) for n, c in _scaled_box(page_width, page_height).items()]
    taken = usable.select(*LINE, F.col("word_num").cast("long").alias("word_num"), F.col("text").cast("string").alias("text"), F.col("conf").cast("double").alias("conf"), *boxes)
    # words of a line mostly come one after the other: what is dealt out and sorted are their runs, one row each
    return taken.mapInArrow(lambda batches: _by_line(_line_runs)(map(_stripped, batches)), runs).repartition(*LINE).sortWithinPartitions(*LINE).mapInArrow(_by_line(_joined_runs), sums)


def _stripped(words: pa.RecordBatch) -> pa.RecordBatch:
    """The words that are not blank, without outer whitespace."""
    at = words.schema.get_field_index("text")
    text = pc.utf8_trim(words.column(at), characters=fixed.WHITESPACE)
    return words.set_column(at, "text", text).filter(pc.greater(pc.utf8_length(text), 0))


def _line_starts(rows: pa.Table) -> np.ndarray:
    """Where the rows of another line begin; nulls are equal."""
    new = np.ones(len(rows), bool)
    new[1:] = False
    for key in LINE:
        values = rows.column(key).combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
        absent = values.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= absent[1:] != absent[:-1]
    return np.flatnonzero(new)


def _by_line(body: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands on tables that end with a line, and where their lines begin; the last line waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = _line_starts(held)
            if starts[-1]:
                yield body(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None:
            yield body(held, _line_starts(held))

    return run


def _line_runs(words: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """One row per run of words of a line: sums, extent, text from left to right, and each word's place, number and length."""
    n = len(words)
    size = np.diff(np.append(starts, n))
    owner = np.repeat(np.arange(len(starts)), size)
    text = words.column("text").combine_chunks()
    x0, conf, y0, x1, y1 = (words.column(c).to_numpy() for c in ("x0", "conf", "y0", "x1", "y1"))
    number = pc.fill_null(words.column("word_num"), np.iinfo(np.int64).min).to_numpy()
    rank = pc.rank(text, tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((rank, number, x0, owner))
    edges = pa.array(np.append(starts, n).astype(np.int32))
    inner = text.take(pa.array(order))
    line = words.select(LINE).take(pa.array(starts)).combine_chunks()
    columns = [
        *[line.column(c).combine_chunks() for c in LINE], pc.binary_join(pa.ListArray.from_arrays(edges, inner), " "),
        pa.array(np.add.reduceat(conf / 100.0, starts)), pa.array(np.add.reduceat(conf, starts)), pa.array(size.astype(np.int64)),
        *[pa.array(f.reduceat(v, starts)) for f, v in ((np.fmin, x0), (np.fmin, y0), (np.maximum, x1), (np.maximum, y1))],
        *[pa.ListArray.from_arrays(edges, v) for v in (pa.array(x0[order]), pa.array(number[order]), pc.utf8_length(inner))],
    ]
    return pa.RecordBatch.from_arrays(columns, [*LINE, "text", "confidence", "conf_sum", "n_words", "x0", "y0", "x1", "y1", "_at", "_num", "_size"])


def _joined_runs(runs: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Lines from their runs; the words of several runs are put in order again."""
    text = runs.column("text").take(pa.array(starts)).to_pylist()
    ends = np.append(starts, len(runs))
    for i in np.flatnonzero(np.diff(ends) > 1).tolist():
        words: list[tuple[float, int, bytes]] = []
        for run in runs.slice(ends[i], ends[i + 1] - ends[i]).select(["text", "_at", "_num", "_size"]).to_pylist():
            at = 0
            for x, k, size in zip(run["_at"], run["_num"], run["_size"]):
                words.append((x, k, run["text"][at : at + size].encode()))
                at += size + 1
        text[i] = b" ".join(w[2] for w in sorted(words, key=lambda w: (w[0] != w[0], *w))).decode()
    value = {c: runs.column(c).to_numpy() for c in ("confidence", "conf_sum", "n_words", "x0", "y0", "x1", "y1")}
    line = runs.select(LINE).take(pa.array(starts))
    n = np.add.reduceat(value["n_words"], starts)
    columns = [
        *[line.column(c).combine_chunks() for c in LINE], pa.array(text, pa.string()), pa.array(np.add.reduceat(value["confidence"], starts) / n),
        pa.array(np.add.reduceat(value["conf_sum"], starts)), pa.array(n),
        *[pa.array(f.reduceat(value[c], starts)) for f, c in ((np.fmin, "x0"), (np.fmin, "y0"), (np.maximum, "x1"), (np.maximum, "y1"))],
    ]
    return pa.RecordBatch.from_arrays(columns, [*LINE, "text", "confidence", "conf_sum", "n_words", "x0", "y0", "x1", "y1"])


def page_confidence(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per page: word-weighted mean confidence and number of words; 1.0 for pages without words. One reading of the words."""
    confidence = F.when(_usable(), F.col("conf") / 100.0)
    found = words.groupBy("doc_id", "page_number").agg(F.avg(confidence).alias("mean_confidence"), F.count(confidence).alias("n_words"))
    if pages is None:
        return found.withColumn("mean_confidence", F.coalesce("mean_confidence", F.lit(1.0)))
    every = pages.select("doc_id", "page_number").distinct()
    return every.join(found, ["doc_id", "page_number"], "left").select(
        "doc_id", "page_number", F.coalesce("mean_confidence", F.lit(1.0)).alias("mean_confidence"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
    )


def page_text(lines: DataFrame) -> DataFrame:
    """Full text of each page, lines in order, one per row of text."""
    ordered = F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", "text")))
    return lines.groupBy("doc_id", "page_number").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("full_text")
    )


@F.arrow_udf(ArrayType(LongType()))
def _places(words: pa.Array) -> pa.Array:
    """Where each word of a list begins when they are joined by single spaces."""
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.utf8_length(words.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    before = np.cumsum(sizes) - sizes
    edges = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.minimum(edges[:-1], max(0, len(before) - 1))
    at = before - np.repeat(before[inside], lengths) if len(before) else before
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(at))


def line_words(lines: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Words of confident lines with boxes estimated from character counts.

    Every word gets its share of the line width and every gap one character. A line
    with the sum of its words' confidences is held against the limit by that.
    """
    if "conf_sum" in lines.columns:
        confident = F.col("conf_sum") >= F.col("n_words") * F.lit(float(Decimal(str(min_confidence)) * 100))
    else:
        confident = F.col("confidence") >= min_confidence
    kept = lines.withColumn("text", T.strip(F.col("text"))).where((F.length("text") > 0) & confident)
    split = kept.select(*LINE, "x0", "x1", "y0", "y1", "confidence", F.split("text", r"(?U)\s+").alias("words")).withColumn("at", _places("words"))
    # a line's places are made inside its row, so nothing is dealt out by word
    whole = F.element_at("at", -1) + F.length(F.element_at("words", -1))
    placed = split.withColumn("per_char", (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), whole)).select(
        *LINE, "x0", "x1", "y0", "y1", "confidence", "per_char", F.posexplode_outer(F.arrays_zip("words", "at")).alias("word_num", "w")
    ).select("*", F.col("w.words").alias("word"), F.col("w.at").alias("at"))
    size = F.length("word")
    start = F.col("x0") + F.col("at") * F.col("per_char")
    return placed.select(
        *LINE, "word_num", F.col("word").alias("text"), "confidence", start.alias("wx0"),
        F.least(F.col("x1"), start + size * F.col("per_char")).alias("wx1"), "y0", "y1",
    )


def page_lengths(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number, n_chars): length of a page's stripped lines joined by newlines, without joining them."""
    return elements.groupBy("doc_id", "page_number").agg((F.sum(F.length(T.strip(F.col("content")))) + F.count("*") - 1).alias("n_chars"))


def route_pipeline(pages: DataFrame, documents: DataFrame | None = None, min_chars: int = 100) -> DataFrame:
    """Scanned when a document's pages hold under 100 characters on average; no pages counts as none.

    Pages come with their ``text`` or, from page_lengths, with ``n_chars``.
    """
    size = F.col("n_chars") if "n_chars" in pages.columns else F.length(T.strip(F.col("text")))
    routed = pages.groupBy("doc_id").agg(F.avg(size).alias("avg_chars"))
    if documents is not None:
        routed = documents.select("doc_id").join(routed, "doc_id", "left")
    avg = F.coalesce("avg_chars", F.lit(0.0))
    return routed.select("doc_id", avg.alias("avg_chars"), (avg < min_chars).alias("is_scanned"),
                         F.when(avg < min_chars, "scanned").otherwise("digital").alias("pipeline_type"))


def _rows_by_mean(gap: float):
    """Marks the heights that begin a row; the state is the row's sum of heights and number of words."""

    def step(state, heights, counts):
        total, n = state or (0.0, 0)
        marks = []
        for y, k in zip(heights, counts):
            joins = n > 0 and abs(y - total / n) <= gap
            marks.append(int(not joins))
            total, n = (total + y * k, n + k) if joins else (y * k, k)
        return marks, [total, n]

    return step


def _anchors(gap: float):
    """Marks the left edges that are column anchors; the state is the last one."""

    def step(state, edges):
        marks = []
        for x in edges:
            new = state is None or abs(x - state) > gap
            marks.append(int(new))
            state = x if new else state
        return marks, state

    return step


def _page_grids(words: pa.Table, keys: list[str], row_gap: float, column_gap: float) -> pa.RecordBatch:
    """The cells of whole regions, whose words lie together."""
    n = len(words)
    new = np.zeros(n, bool)
    for key in keys:
        values = words.column(key).combine_chunks()
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    page = np.cumsum(new)
    starts = np.concatenate([[0], np.flatnonzero(new)])
    x, y = (words.column(c).to_numpy() for c in ("x0", "y0"))

    def numbered(values: np.ndarray, step: Step, counted: bool) -> tuple[np.ndarray, ...]:
        """Page and value of every distinct value of a page in order, the marks of a fold along them added up, and which one each word has."""
        order = np.lexsort((values, page))
        first = np.ones(n, bool)
        first[1:] = (page[order][1:] != page[order][:-1]) | (values[order][1:] != values[order][:-1])
        at = np.flatnonzero(first)
        of = np.empty(n, np.int64)
        of[order] = np.cumsum(first) - 1
        own, distinct = page[order][at], values[order][at]
        size, given = np.diff(np.append(at, n)).tolist(), distinct.tolist()
        edges = np.searchsorted(own, np.arange(len(starts) + 1)).tolist()
        marks = [m for i, j in zip(edges, edges[1:]) for m in (step(None, given[i:j], size[i:j]) if counted else step(None, given[i:j]))[0]]
        total = np.cumsum(marks)
        return own, distinct, total, of

    own, _, total, of = numbered(y, _rows_by_mean(row_gap), True)
    row = (total - total[np.searchsorted(own, own)])[of]
    own, edge, total, of = numbered(x, _anchors(column_gap), False)
    opens = np.flatnonzero(np.diff(total, prepend=0))
    anchor, home = edge[opens], own[opens]
    base = np.searchsorted(home, np.arange(len(starts)))
    n_cols = np.diff(np.append(base, len(home)))
    # every edge lies at or behind its own anchor; the next one may be closer
    after = np.minimum(total, len(anchor) - 1)
    closer = (total < len(anchor)) & (home[after] == own) & (anchor[after] - edge < edge - anchor[total - 1])
    col = (total - 1 - base[own] + closer)[of]

    text = words.column("text").combine_chunks()
    text_rank = pc.rank(text, tiebreaker="dense").to_numpy().astype(np.int64)
    number = words.column("word_num").to_numpy()
    order = np.lexsort((text_rank, number, x, y, col, row, page))
    cell = np.ones(n, bool)
    cell[1:] = np.any([c[order][1:] != c[order][:-1] for c in (page, row, col)], axis=0)
    at = np.flatnonzero(cell)
    ends, given = np.append(at, n).tolist(), text.take(pa.array(order)).to_pylist()
    content = [" ".join(t for t in given[i:j] if t is not None).strip(fixed.WHITESPACE) for i, j in zip(ends, ends[1:])]
    kept = np.fromiter(map(bool, content), bool, len(content))
    at = order[at[kept]]
    where, row, col = page[at], row[at], col[at]
    # rows without any text are left out and the others numbered anew
    fresh = np.ones(len(at), bool)
    fresh[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
    count = np.cumsum(fresh)
    dense = count - count[np.searchsorted(where, where)] if len(at) else count
    columns = [words.column(k).combine_chunks().take(pa.array(starts[where])) for k in keys]
    numbers = [pa.array(v.astype(np.int32)) for v in (dense, col)]
    return pa.RecordBatch.from_arrays(
        [*columns, *numbers, pa.array([c for c, k in zip(content, kept.tolist()) if k], pa.string()), pa.array(n_cols[where].astype(np.int32))],
        [*keys, "row_idx", "col_idx", "content", "n_cols"],
    )


def _page_csv(words: pa.Table, keys: list[str], row_gap: float, column_gap: float) -> pa.RecordBatch:
    """The CSV text of whole regions, whose words lie together: what cells_to_csv() makes of all their cells."""
    grid = _page_grids(words, keys, row_gap, column_gap)
    n = grid.num_rows
    page, line = np.ones(n, bool), np.ones(n, bool)
    page[1:] = False
    for key in keys:
        values = grid.column(key)
        page[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    row, col, width = (grid.column(c).to_numpy().astype(np.int64) for c in ("row_idx", "col_idx", "n_cols"))
    line[1:] = page[1:] | (row[1:] != row[:-1])
    # commas in front of a field, those of empty cells too; the last field of a row has the rest of its row's behind it
    front = col.copy()
    front[1:] -= np.where(line[1:], 0, col[:-1])
    behind = np.where(np.append(line[1:], True), width - 1 - col, 0)
    ends = np.where(line & ~page, "\r\n", "").tolist()
    texts = [f'"{t.replace(chr(34), chr(34) * 2)}"' if _QUOTED.search(t) else t for t in grid.column("content").to_pylist()]
    parts = [f"{end}{',' * before}{t}{',' * after}" for end, before, t, after in zip(ends, front.tolist(), texts, behind.tolist())]
    at = np.flatnonzero(page)
    joined = ["".join(parts[i:j]).strip(fixed.WHITESPACE) for i, j in zip(at.tolist(), np.append(at, n)[1:].tolist())]
    return pa.RecordBatch.from_arrays([*[grid.column(k).take(pa.array(at)) for k in keys], pa.array(joined, pa.string())], [*keys, "csv_repr"])


def _whole_pages(words: DataFrame, keys: list[str], most: int, body: Callable[[pa.Table], pa.RecordBatch], made: StructType) -> DataFrame:
    """What ``body`` makes of regions of at most ``most`` words: one shuffle brings each together, and tasks take some regions at a time.

    Words of a region mostly come one after the other: what is dealt out and sorted are their runs, one row each.
    """
    names = ["word_num", "text", "x0", "y0"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for k in keys:
                values = batch.column(batch.schema.get_field_index(k))
                new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            edges = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (*keys, *names)]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(starts)) for c in columns[: len(keys)]], *[pa.ListArray.from_arrays(edges, c) for c in columns[len(keys) :]]], [*keys, *names])

    def unpacked(batch: pa.RecordBatch) -> pa.Table:
        owner = pc.list_parent_indices(batch.column(len(keys)))
        return pa.table([*[batch.column(i).take(owner) for i in range(len(keys))], *[batch.column(len(keys) + i).flatten() for i in range(len(names))]], [*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = unpacked(batch) if held is None else pa.concat_tables([held, unpacked(batch)])
            if len(held) >= most:
                last = [held.column(k)[-1] for k in keys]
                same = np.ones(len(held), bool)
                for k, v in zip(keys, last):
                    same &= pc.equal(held.column(k), v).to_numpy()
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield body(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield body(held)

    taken = words.select(*keys, "word_num", "text", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"))
    own = taken.select(*keys).schema.fields
    packed = reduce(lambda schema, c: schema.add(c, ArrayType(taken.schema[c].dataType)), names, StructType([*own]))
    return taken.mapInArrow(runs, packed).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, StructType([*own, *made.fields]))


def _whole_pages_to_grid(words: DataFrame, keys: list[str], row_gap: float, column_gap: float, most: int) -> DataFrame:
    """words_to_grid for regions of at most ``most`` words."""
    made = StructType().add("row_idx", IntegerType()).add("col_idx", IntegerType()).add("content", StringType()).add("n_cols", IntegerType())
    return _whole_pages(words, keys, most, lambda held: _page_grids(held, keys, row_gap, column_gap), made)


def _located(words: DataFrame, keys: list[str]) -> DataFrame:
    """The words whose region and place are known."""
    return words.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "x0", "y0")]))


def _large_regions(words: DataFrame, keys: list[str], whole: int) -> DataFrame:
    return cut_lineage(words.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > whole).select(*keys))


@prepared
def words_to_grid(words: DataFrame, keys: list[str], row_gap: float = 5.0, column_gap: float = 30.0, pieces: int | None = None, whole: int = 1 << 16) -> DataFrame:
    """Table cells (keys, row_idx, col_idx, content) from the words of a region (x0, y0, text).

    Words sorted by height join the current row while they lie within 5 of its
    mean; column anchors are left edges more than 30 from the anchor before; a
    word goes to the nearest anchor. Regions of up to ``whole`` words are shuffled once and
    laid out inside tasks; larger ones, in any number of tasks (in ``pieces``, if given, all regions), by folds.
    """
    words = _located(words, keys)
    if pieces is not None:
        return _pages_to_grid_by_folds(words, keys, row_gap, column_gap, pieces)
    large = _large_regions(words, keys, whole)
    if large.isEmpty():
        return _whole_pages_to_grid(words, keys, row_gap, column_gap, whole)
    small = _whole_pages_to_grid(words.join(large, keys, "left_anti"), keys, row_gap, column_gap, whole)
    return small.unionByName(_pages_to_grid_by_folds(words.join(large, keys, "left_semi"), keys, row_gap, column_gap, None))


def _pages_to_grid_by_folds(words: DataFrame, keys: list[str], row_gap: float, column_gap: float, pieces: int | None) -> DataFrame:
    """words_to_grid for regions of any size.

    Both rules depend only on the distinct heights and left edges, so those are counted first and only they are folded,
    a region in any number of tasks (see folds); the words themselves are joined back and aggregated per cell.
    """
    heights = words.groupBy(*keys, "y0").agg(F.count("*").alias("n"))
    rows = ordered_fold(heights, keys, ["y0"], ["y0", "n"], _rows_by_mean(row_gap), pieces).select(*keys, "y0", (F.col("ord") - 1).cast("int").alias("row_idx"))
    edges = ordered_fold(words.select(*keys, "x0").distinct(), keys, ["x0"], ["x0"], _anchors(column_gap), pieces)
    # every edge lies at or behind its own anchor; the next one may be closer
    anchors = edges.groupBy(*keys, "ord").agg(F.min("x0").alias("anchor"))
    following = anchors.select(*keys, (F.col("ord") - 1).alias("ord"), F.col("anchor").alias("next"))
    width = anchors.groupBy(*keys).agg(F.max("ord").cast("int").alias("n_cols"))
    cols = edges.join(anchors, [*keys, "ord"]).join(following, [*keys, "ord"], "left").join(width, keys)
    closer = F.coalesce(F.col("next") - F.col("x0") < F.col("x0") - F.col("anchor"), F.lit(False))
    cols = cols.select(*keys, "x0", "n_cols", (F.col("ord") - F.when(closer, 0).otherwise(1)).cast("int").alias("col_idx"))
    placed = words.join(rows, [*keys, "y0"]).join(cols, [*keys, "x0"])
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "word_num", "text")))
    cells = placed.groupBy(*keys, "row_idx", "col_idx").agg(
        T.strip(F.array_join(F.transform(ordered, lambda w: w["text"]), " ")).alias("content"), F.first("n_cols").alias("n_cols")
    )
    kept = cells.where(F.length("content") > 0)
    numbers = running_number(kept.select(*keys, "row_idx").distinct(), keys, ["row_idx"], "_row")
    return kept.join(numbers, [*keys, "row_idx"]).withColumn("row_idx", F.col("_row").cast("int")).drop("_row")


def grid_to_cells(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of the full grid, empty where there was no word; the first row is the header.

    A row's cells are brought together once; the empty ones are made in between.
    """
    filled = F.array_sort(F.collect_list(F.struct("col_idx", "content")))
    end = F.array(F.struct(F.col("n_cols").alias("col_idx"), F.lit(None).cast("string").alias("content")))
    rows = grid.groupBy(*keys, "row_idx").agg(filled.alias("cells"), F.first("n_cols").alias("n_cols")).select(*keys, "row_idx", F.concat("cells", end).alias("cells"))

    def upto(cells: Column) -> Column:
        """Each cell with the empty ones in front of it."""
        def gap(c: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(cells, i - 1)["col_idx"] + 1).otherwise(0)
            empty = F.when(begin < c["col_idx"], F.sequence(begin, c["col_idx"] - 1)).otherwise(F.array().cast("array<int>"))
            return F.concat(F.transform(empty, lambda k: F.struct(k.alias("col_idx"), F.lit("").alias("content"))), F.array(c))

        return F.flatten(F.transform(cells, gap))

    every = rows.select(*keys, "row_idx", F.explode(T.let(F.col("cells"), upto)).alias("c")).where("c.content is not null")
    return every.select(*keys, "row_idx", "c.col_idx", "c.content", (F.col("row_idx") == 0).alias("is_header"))


def csv_field(text: Column) -> Column:
    """A field in quotes when it holds a comma, a quote or a line end."""
    return F.when(text.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def cells_to_csv(cells: DataFrame, keys: list[str]) -> DataFrame:
    """CSV text of each grid, rows ended by CRLF, outer whitespace removed."""
    in_row = F.array_sort(F.collect_list(F.struct("col_idx", csv_field(F.col("content")).alias("f"))))
    rows = cells.groupBy(*keys, "row_idx").agg(F.array_join(F.transform(in_row, lambda c: c["f"]), ",").alias("line"))
    in_grid = F.array_sort(F.collect_list(F.struct("row_idx", "line")))
    return rows.groupBy(*keys).agg(
        T.strip(F.array_join(F.transform(in_grid, lambda r: r["line"]), "\r\n")).alias("csv_repr")
    )


@prepared
def words_to_csv(words: DataFrame, keys: list[str], row_gap: float = 5.0, column_gap: float = 30.0, whole: int = 1 << 16) -> DataFrame:
    """(keys, csv_repr): the CSV text of each region's grid, as words_to_grid, grid_to_cells and cells_to_csv give it.

    Regions of up to ``whole`` words are written in the task that lays them out, so no cell is a row of a shuffle; larger ones go through cells.
    """
    words = _located(words, keys)
    large = _large_regions(words, keys, whole)

    def small(own: DataFrame) -> DataFrame:
        return _whole_pages(own, keys, whole, lambda held: _page_csv(held, keys, row_gap, column_gap), StructType().add("csv_repr", StringType()))

    if large.isEmpty():
        return small(words)
    grid = _pages_to_grid_by_folds(words.join(large, keys, "left_semi"), keys, row_gap, column_gap, None)
    return small(words.join(large, keys, "left_anti")).unionByName(cells_to_csv(grid_to_cells(grid, keys), keys))
