"""Token-bounded chunks from section text, and whole chunks for tables, figures and equations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T
from quire.operators import scans
from quire.operators.sections import assign_sections
from quire.session import prepared, stored

BOX = ["x0", "y0", "x1", "y1"]
CHUNK_COLUMNS = [
    "chunk_id", "doc_id", "chunk_type", "content", "page_number", "section", "section_level",
    *BOX, "element_ids", "token_count", "first_pos", "part",
]
_BLOCKS_PER_STRETCH = 1024


def _with_box(elements: DataFrame) -> DataFrame:
    """Elements of a source without geometry get empty boxes."""
    missing = [c for c in BOX if c not in elements.columns]
    return elements.select("*", *[F.lit(None).cast("double").alias(c) for c in missing])


def _greedy(tokens: str, max_tokens: int, state: str, fill: str) -> str:
    """SQL of the fill after one more element. A negative size marks a forced cut."""
    return (f"case when {tokens} < 0 then 0 when {state}.{fill} + {tokens} > {max_tokens} "
            f"then {tokens} else {state}.{fill} + {tokens} end")


def _starts(tokens: str, max_tokens: int, state: str) -> str:
    return f"({tokens} >= 0 and ({state}.fill = 0 or {state}.fill + {tokens} > {max_tokens}))"


def _entry_states(blocks: DataFrame, max_tokens: int) -> DataFrame:
    """What is in the buffer when a section continues into a later block.

    Greedy packing is sequential, but its state is one small number (tokens in the
    buffer). So each continuing block is summarised as a table from entry state
    to exit state; tables compose, first over stretches of blocks, then along the
    stretches of a section. Only sections longer than one block take part.
    Returns (doc_id, section_pos, blk, entry) with entry = struct<fill,start>.
    """
    key = ["doc_id", "section_pos"]
    state = "struct<fill:int,start:bigint>"
    later = blocks.where("blk > home")
    step = (
        f"named_struct('fill', {_greedy('e.tokens', max_tokens, 's', 'fill')}, "
        f"'start', case when {_starts('e.tokens', max_tokens, 's')} then cast(e.pos as bigint) "
        f"when e.tokens < 0 then cast(null as bigint) else s.start end)"
    )
    identity = (f"transform(sequence(0, {max_tokens}), f -> "
                f"cast(named_struct('fill', f, 'start', case when f > 0 then -2L end) as {state}))")
    # start -2 stands for "the bin that was open on entry"
    then = (
        "transform(acc, s -> named_struct('fill', t[s.fill].fill, 'start', "
        "case when t[s.fill].start = -2 then s.start else t[s.fill].start end))"
    )
    tables = later.select(
        *key, "blk", F.floor(F.col("blk") / _BLOCKS_PER_STRETCH).alias("stretch"),
        F.expr(f"aggregate(items, {identity}, (acc, e) -> transform(acc, s -> {step}))").alias("table"),
    )
    firsts = blocks.where("blk = home").join(later.select(*key).distinct(), key, "left_semi").select(
        *key,
        F.expr(f"aggregate(items, cast(named_struct('fill', 0, 'start', null) as {state}), (s, e) -> {step})").alias("exit"),
    )
    stretches = tables.groupBy(*key, "stretch").agg(
        F.array_sort(F.collect_list(F.struct("blk", "table"))).alias("run")
    )
    composed = stretches.select(
        *key, "stretch",
        F.expr(f"aggregate(transform(run, r -> r.table), {identity}, (acc, t) -> {then})").alias("table"),
    )
    advance = (
        "named_struct('fill', t.table[s.now.fill].fill, 'start', "
        "case when t.table[s.now.fill].start = -2 then s.now.start else t.table[s.now.fill].start end)"
    )

    def entries(run: str, at: str, label: str) -> Column:
        """Walk tables in order, remembering the state in front of each."""
        kind = f"struct<{label}:bigint,entry:{state}>"
        return F.expr(
            f"aggregate({run}, named_struct('now', {at}, 'seen', cast(array() as array<{kind}>)), "
            f"(s, t) -> named_struct('now', {advance}, 'seen', concat(s.seen, array(named_struct('{label}', t.{label}, 'entry', s.now)))), "
            "s -> s.seen)"
        )

    along = (
        composed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("stretch", "table"))).alias("run"))
        .join(firsts, key)
        .select(*key, F.explode(entries("run", "exit", "stretch")).alias("e"))
        .select(*key, "e.stretch", F.col("e.entry").alias("at"))
    )
    return (
        stretches.join(along, [*key, "stretch"])
        .select(*key, F.explode(entries("run", "at", "blk")).alias("e"))
        .select(*key, "e.blk", "e.entry")
    )


@prepared
def pack_chunks(
    elements: DataFrame,
    max_tokens: int = fixed.MAX_TOKENS,
    min_tokens: int = 64,
    overlap_tokens: int = 64,
    block: int = scans.BLOCK,
    include_headers: bool = False,
    with_text: bool = True,
) -> DataFrame:
    """Pack the text of each section greedily into chunks of at most ``max_tokens``.

    An element over the limit is cut into sentences, which are packed by the same
    rule on their own; one oversized sentence stays whole. ``min_tokens`` and
    ``overlap_tokens`` are accepted for compatibility and have no effect.

    Text travels once, into (document, section, block) groups of bounded size, which are stored and cut from there;
    without ``with_text`` only sizes do, for chunks that are merely counted (their content is empty).
    """
    # sections run along the blocks that are packed, so one shuffle serves both
    placed = assign_sections(_with_box(elements).withColumn("blk", scans.pos_block("pos", block)), include_headers, "blk")
    text = T.strip(F.col("content"))
    units = placed.withColumn("text", text).where(F.length("text") > 0)
    size = T.estimate_tokens(F.col("text"))
    units = units.select(
        "doc_id", "section_pos", "section", "section_level", "pos", "page_number", *BOX, "text",
        (F.col("text") if with_text else F.lit("")).alias("kept"), size.alias("size"), "blk",
    )
    fits = F.col("size") <= max_tokens
    item = F.struct(
        "pos", F.when(fits, F.col("size")).otherwise(F.lit(-1)).alias("tokens"),
        "page_number", *BOX, F.when(fits, F.col("kept")).otherwise(F.col("text")).alias("text"),
    )
    # first() is exact: section attributes are the same in every row of a section
    blocks = stored(units.groupBy("doc_id", "section_pos", "blk").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.first("section").alias("section"), F.first("section_level").alias("section_level"),
    ), "blocks")
    oversized = blocks.select("doc_id", "section", "section_level", F.explode_outer(F.filter("items", lambda i: i["tokens"] < 0)).alias("i")).where("i is not null")
    return (
        _packed_blocks(blocks, max_tokens)
        .unionByName(_split_elements(oversized.select("doc_id", "section", "section_level", "i.*"), max_tokens))
        .select(
            F.concat_ws(":", F.col("doc_id"), F.lit("text"), F.col("first_pos"), F.col("part")).alias("chunk_id"),
            "doc_id",
            F.when(F.contains(F.lower("section"), F.lit("abstract")), F.lit("abstract")).otherwise(F.lit("text")).alias("chunk_type"),
            "content", "page_number", "section", "section_level", *BOX, "element_ids",
            T.estimate_tokens(F.col("content")).alias("token_count"),
            "first_pos", "part",
        )
    )


def chunk_sizes(text: Column, etype: Column, max_tokens: int = fixed.MAX_TOKENS) -> tuple[Column, Column]:
    """Of an element with this stripped text: its size for count_chunks, and the chunks it makes on its own.

    The size is null for elements without section text and negative where the buffer is cut: at a section header, and
    at an element over the limit, which is packed by sentences here.
    """
    size = T.estimate_tokens(text)
    sizes = F.transform(T.split_sentences(text), T.estimate_tokens)
    state = lambda fill, n: F.struct(fill.cast("int").alias("fill"), n.cast("int").alias("n"))
    parts = F.aggregate(
        sizes, state(F.lit(0), F.lit(0)),
        lambda s, i: F.when((s["n"] == 0) | (s["fill"] + i > max_tokens), state(i, s["n"] + 1)).otherwise(state(s["fill"] + i, s["n"])),
        lambda s: s["n"],
    )
    body = ~etype.isin(fixed.NON_TEXT_TYPES + fixed.SECTION_TYPES) & (F.length(text) > 0)
    tokens = F.when(etype.isin(fixed.SECTION_TYPES), -1).when(body, F.when(size <= max_tokens, size).otherwise(-1))
    return tokens, F.when(body & (size > max_tokens), parts).otherwise(0)


def count_chunks(blocks: DataFrame, max_tokens: int = fixed.MAX_TOKENS) -> DataFrame:
    """doc_id and n, parts of the number of chunks that pack_chunks gives, of blocks of catalog.element_blocks.

    A section header empties the buffer as an element over the limit does, so a document is packed in one run over
    its sizes. Only documents of several blocks need the buffer a block begins with.
    """
    sized = blocks.select(
        "doc_id", F.lit(0).alias("section_pos"), "blk", "parts",
        F.filter(F.transform("items", lambda i: F.struct(i["pos"].alias("pos"), i["tokens"].alias("tokens"))), lambda i: i["tokens"].isNotNull()).alias("items"),
    )
    later = blocks.where("blk > 0").select("doc_id").distinct()
    long = sized.drop("parts").join(later, "doc_id", "left_semi").withColumn("home", F.min("blk").over(Window.partitionBy("doc_id")))
    entries = _entry_states(long, max_tokens).select("doc_id", "blk", F.col("entry.fill").alias("at"))
    state = "struct<fill:int,n:int>"
    n = (
        f"aggregate(items, cast(named_struct('fill', coalesce(at, 0), 'n', 0) as {state}), "
        f"(s, e) -> named_struct('fill', {_greedy('e.tokens', max_tokens, 's', 'fill')}, "
        f"'n', s.n + case when {_starts('e.tokens', max_tokens, 's')} then 1 else 0 end), s -> s.n)"
    )
    return sized.join(entries, ["doc_id", "blk"], "left").select("doc_id", (F.expr(n) + F.col("parts")).alias("n"))


def _packed_blocks(blocks: DataFrame, max_tokens: int) -> DataFrame:
    """Bins of the elements that fit; the blocks are read as a table, so they are made once."""
    key = ["doc_id", "section_pos"]

    state = "struct<fill:int,starts:array<int>>"
    fold = (
        "aggregate(sequence(0, size(items) - 1), "
        f"cast(named_struct('fill', coalesce(entry.fill, 0), 'starts', array()) as {state}), "
        f"(s, i) -> named_struct('fill', {_greedy('items[i].tokens', max_tokens, 's', 'fill')}, "
        f"'starts', case when {_starts('items[i].tokens', max_tokens, 's')} then concat(s.starts, array(i)) else s.starts end), "
        "s -> s.starts)"
    )

    def cut(df: DataFrame) -> DataFrame:
        """Slices of a block's items, one per bin; bin_pos names the bin across blocks."""
        started = df.withColumn("starts", F.expr(fold))
        heads = F.expr(
            "case when size(items) > 0 and not array_contains(starts, 0) then concat(array(0), starts) else starts end"
        )
        return (
            started.withColumn("cuts", heads)
            .select("*", F.posexplode_outer("cuts").alias("k", "from"))
            .withColumn("to", F.coalesce(F.try_element_at(F.col("cuts"), F.col("k") + 2), F.size("items")))
            .withColumn(
                "members",
                F.filter(F.expr("slice(items, from + 1, to - from)"), lambda m: m["tokens"] >= 0),
            )
            .where(F.size("members") > 0)
            .withColumn(
                "bin_pos",
                F.when(F.array_contains("starts", F.col("from")), F.expr("members[0].pos").cast("bigint"))
                .otherwise(F.expr("entry.start")),
            )
            .select("doc_id", "section_pos", "section", "section_level", "bin_pos", "members")
        )

    nothing = F.lit(None).cast("struct<fill:int,start:bigint>")
    # the same plan at every size; where no section crosses a block, its branch comes out empty at run time
    # every such section holds the edge of a block, so they are few and the blocks need not be dealt out to be told apart
    crossing = F.broadcast(blocks.groupBy(*key).agg(F.min("blk").alias("home"), F.max("blk").alias("last")).where("last > home").select(*key))
    whole = cut(blocks.join(crossing, key, "left_anti").withColumn("entry", nothing))
    long_blocks = blocks.join(crossing, key, "left_semi")
    slim = long_blocks.select(
        *key, "blk",
        F.transform("items", lambda i: F.struct(i["pos"].alias("pos"), i["tokens"].alias("tokens"))).alias("items"),
        F.min("blk").over(Window.partitionBy(*key)).alias("home"),
    )
    pieces = cut(long_blocks.join(_entry_states(slim, max_tokens), [*key, "blk"], "left"))
    # a bin holds at most max_tokens elements, so re-joining its pieces is bounded
    joined = pieces.groupBy("doc_id", "section_pos", "bin_pos").agg(
        F.first("section").alias("section"), F.first("section_level").alias("section_level"),
        F.array_sort(F.flatten(F.collect_list("members"))).alias("members"),
    )
    return _as_chunks(whole.unionByName(joined))


def _as_chunks(bins: DataFrame) -> DataFrame:
    m = F.col("members")
    extent = [(F.array_min if c in ("x0", "y0") else F.array_max)(F.col(f"members.{c}")).alias(c) for c in BOX]
    return bins.select(
        "doc_id", "section", "section_level",
        F.array_join(F.transform(m, lambda e: e["text"]), "\n\n").alias("content"),
        F.element_at(m, -1)["page_number"].alias("page_number"),
        *extent,
        F.transform(m, lambda e: F.concat_ws(":", F.col("doc_id"), e["pos"])).alias("element_ids"),
        F.col("bin_pos").alias("first_pos"),
        F.lit(0).alias("part"),
    )


def _split_elements(oversized: DataFrame, max_tokens: int) -> DataFrame:
    """Sentence packing inside each oversized element; nothing leaves the row."""
    state = "struct<fill:int,starts:array<int>>"
    sized = oversized.withColumn("sentences", T.split_sentences(F.col("text"))).withColumn(
        "sizes", F.transform("sentences", T.estimate_tokens)
    )
    fold = (
        "aggregate(sequence(0, size(sizes) - 1), "
        f"cast(named_struct('fill', 0, 'starts', array()) as {state}), "
        f"(s, i) -> case when size(s.starts) = 0 or s.fill + sizes[i] > {max_tokens} "
        "then named_struct('fill', sizes[i], 'starts', concat(s.starts, array(i))) "
        "else named_struct('fill', s.fill + sizes[i], 'starts', s.starts) end, s -> s.starts)"
    )
    return (
        sized.withColumn("starts", F.expr(fold))
        .select("*", F.posexplode_outer("starts").alias("part", "from"))
        .withColumn("to", F.coalesce(F.try_element_at(F.col("starts"), F.col("part") + 2), F.size("sizes")))
        .select(
            "doc_id", "section", "section_level",
            F.array_join(F.expr("slice(sentences, from + 1, to - from)"), "\n\n").alias("content"),
            "page_number", *BOX,
            F.array(F.concat_ws(":", "doc_id", "pos")).alias("element_ids"),
            F.col("pos").cast("bigint").alias("first_pos"), "part",
        )
    )


#: What a chunk of an entity keeps of it; a kind leaves null what it does not have.
METADATA = {
    "rows": "int", "cols": "int", "caption": "string", "image_path": "string", "figure_type": "string",
    "raw_text": "string", "latex": "string", "variables": "array<string>", "is_inline": "boolean",
}


def _entity_chunks(entities: DataFrame, kind: str, content: Column, keeps: list[str], part: Column | None = None) -> DataFrame:
    boxed = _with_box(entities)
    values = [(F.col(f) if f in keeps and f in boxed.columns else F.lit(None)).cast(t).alias(f) for f, t in METADATA.items()]
    return boxed.select(
        F.concat_ws(":", F.lit(kind), F.col(f"{kind}_id")).alias("chunk_id"),
        "doc_id",
        F.lit(kind).alias("chunk_type"),
        content.alias("content"),
        "page_number",
        F.lit(None).cast("string").alias("section"),
        F.lit(0).alias("section_level"),
        *BOX,
        F.array(F.col(f"{kind}_id")).alias("element_ids"),
        T.estimate_tokens(content).alias("token_count"),
        F.col("pos").cast("bigint").alias("first_pos"),
        (F.lit(0) if part is None else part).alias("part"),
        F.struct(*values).alias("metadata"),
    )


def _labelled(prefix: str, column: str) -> Column:
    return F.when(F.length(column) > 0, F.concat(F.lit(prefix), F.col(column)))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Caption plus CSV, or else summary; a sentence about the size when there is neither."""
    parts = F.concat_ws(
        "\n\n",
        _labelled("Table Caption: ", "caption"),
        F.coalesce(_labelled("Table Data (CSV):\n", "csv_repr"), _labelled("Table Summary: ", "summary")),
    )
    fallback = F.concat(
        F.lit("Table on page "), F.col("page_number"), F.lit(" with "), F.col("rows"), F.lit(" rows and "),
        F.col("cols"), F.lit(" columns."),
    )
    return _entity_chunks(tables, "table", F.when(F.length(T.strip(parts)) > 0, parts).otherwise(fallback), ["rows", "cols", "caption"])


def figure_chunks(figures: DataFrame) -> DataFrame:
    parts = F.concat_ws(
        "\n\n", _labelled("Figure Caption: ", "caption"), _labelled("Figure Description: ", "description")
    )
    fallback = F.concat(
        F.lit("Figure on page "), F.col("page_number"), F.lit(" ("),
        F.coalesce(F.nullif(F.col("figure_type"), F.lit("")), F.lit("image")), F.lit(")."),
    )
    return _entity_chunks(figures, "figure", F.when(F.length(T.strip(parts)) > 0, parts).otherwise(fallback), ["image_path", "figure_type", "caption"])


def equation_chunks(equations: DataFrame) -> DataFrame:
    body = F.coalesce(F.nullif(F.col("latex"), F.lit("")), F.col("raw_text"))
    content = F.concat(F.lit("Equation: "), body, F.coalesce(_labelled("\nExplanation: ", "explanation"), F.lit("")))
    # an element may hold several equations; they keep their order of discovery
    part = F.col("source_order") * F.lit(1 << 32) + F.col("match_pos")
    return _entity_chunks(equations, "equation", content, ["raw_text", "latex", "variables", "is_inline"], part)


@prepared
def union_entities(*kinds: DataFrame) -> DataFrame:
    """All chunk kinds in one relation."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)


KIND_ORDER = ["table", "figure", "equation"]


@prepared
def order_chunks(chunks: DataFrame) -> DataFrame:
    """Adds place: the position in its document by page and height; ties keep tables, figures, equations, text, in list order."""
    kind = F.when(F.col("chunk_type") == "table", 0).when(F.col("chunk_type") == "figure", 1).when(
        F.col("chunk_type") == "equation", 2).otherwise(3)
    order = Window.partitionBy("doc_id").orderBy("page_number", F.coalesce("y0", F.lit(0.0)), kind, "first_pos", "part")
    return chunks.withColumn("place", F.row_number().over(order))
