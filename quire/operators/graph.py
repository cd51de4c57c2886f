"""Document knowledge graphs as node and edge tables, for a whole corpus at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire import fixed
from quire.operators import scans
from quire.session import cut_lineage, prepared

#: Attributes of nodes; a type of node leaves null what it does not have.
ATTRIBUTES = {
    "page_number": "int", "content": "string", "raw_text": "string", "caption": "string", "context": "string",
    "filename": "string", "page_count": "int", "element_type": "string", "level": "int", "rows": "int", "cols": "int", "figure_type": "string", "image_path": "string",
    "latex": "string", "is_inline": "boolean", "variables": "array<string>", "authors": "array<string>", "year": "int", "doi": "string", "venue": "string",
}
NODE_FIELDS = ["node_id", "doc_id", "node_type", "label", *ATTRIBUTES]
SEARCH_FIELDS = ["label", "content", "raw_text", "caption", "context"]
#: Characters of the longest runs in the index of searched fields.
GRAM = 3


def doc_node(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).cast("string")


def page_node(page: str = "page_number") -> Column:
    return F.concat(F.lit("page:"), doc_node(), F.lit(":"), F.col(page).cast("string"))


def element_node(pos: str = "pos") -> Column:
    return F.concat(F.lit("element:"), doc_node(), F.lit(":"), F.col(pos).cast("string"))


def author_node(author: Column) -> Column:
    return F.concat(F.lit("author:"), F.replace(F.lower(author), F.lit(" "), F.lit("_")))


def entity_node(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(f"{kind}_id"))


def _nodes(df: DataFrame, kind: str | Column, node_id: Column, label: Column, *attributes: str) -> DataFrame:
    return df.select(
        node_id.alias("node_id"), "doc_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("node_type"), label.alias("label"),
        *[(F.col(f) if f in attributes and f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in ATTRIBUTES.items()],
    )


@prepared
def build_nodes(
    metadata: DataFrame | None = None, elements: DataFrame | None = None, tables: DataFrame | None = None, figures: DataFrame | None = None,
    equations: DataFrame | None = None, references: DataFrame | None = None, citations: DataFrame | None = None,
) -> DataFrame:
    """All nodes of all documents, of the kinds whose tables are given; an author is one node across the corpus (doc_id null)."""
    page = F.col("page_number")
    caption = F.nullif(F.col("caption"), F.lit(""))
    parts = []
    if metadata is not None:
        authors = metadata.select(F.explode("authors").alias("author")).groupBy(author_node(F.col("author")).alias("id")).agg(
            F.min("author").alias("author")
        ).withColumn("doc_id", F.lit(None).cast(metadata.schema["doc_id"].dataType))
        pages = metadata.where("page_count >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"))
        parts += [
            _nodes(metadata, "document", doc_node(), F.coalesce("title", "filename"), "filename", "page_count"),
            _nodes(authors, "author", F.col("id"), F.col("author")),
            _nodes(pages, "page", page_node(), F.concat(F.lit("Page "), page), "page_number"),
        ]
    if elements is not None:
        section = F.col("element_type").isin(fixed.SECTION_TYPES)
        leveled = elements.withColumn("level", F.when(section, F.col("level"))) if "level" in elements.columns else elements
        parts.append(_nodes(
            leveled, F.when(section, "section").otherwise("paragraph"), element_node(),
            F.when(section, F.substring("content", 1, 80)).otherwise(F.substring("content", 1, 60)), "page_number", "content", "element_type", "level",
        ))
    if tables is not None:
        parts.append(_nodes(tables, "table", entity_node("table"), F.coalesce(caption, F.concat(F.lit("Table (p."), page, F.lit(")"))), "page_number", "caption", "rows", "cols"))
    if figures is not None:
        parts.append(_nodes(figures, "figure", entity_node("figure"), F.coalesce(caption, F.concat(F.lit("Figure (p."), page, F.lit(")"))), "page_number", "caption", "figure_type", "image_path"))
    if equations is not None:
        parts.append(_nodes(equations, "equation", entity_node("equation"), F.substring("raw_text", 1, 60), "page_number", "latex", "is_inline", "variables"))
    if references is not None:
        label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.substring("raw_text", 1, 60))
        parts.append(_nodes(references, "reference", entity_node("reference"), label, "raw_text", "authors", "year", "doi", "venue"))
    if citations is not None:
        parts.append(_nodes(citations, "citation", entity_node("citation"), F.col("cite_key"), "page_number", "context"))
    return reduce(DataFrame.unionByName, parts)


def reading_order_edges(elements: DataFrame) -> DataFrame:
    """FOLLOWS edge from each element to the next one by page and reading order."""
    following = scans.next_row(
        elements.select("doc_id", "page_number", "reading_order", "pos"), ["doc_id"], ["page_number", "reading_order", "pos"],
        element_node(), "next_id", scans.reading_block(),
    )
    return following.where("next_id is not null").select(
        element_node().alias("src"), F.col("next_id").alias("dst"), F.lit("follows").alias("edge_type"), "doc_id", F.lit(9).alias("step")
    )


@prepared
def page_edges(metadata: DataFrame, elements: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """APPEARS_IN edges of elements and entities to the pages their document really has."""
    steps = {"table": 5, "figure": 6, "equation": 7, "citation": 8}
    located = [elements.select(element_node().alias("src"), "doc_id", "page_number", F.lit(4).alias("step"))] + [
        df.select(entity_node(kind).alias("src"), "doc_id", "page_number", F.lit(steps[kind]).alias("step"))
        for kind, df in entities.items()
    ]
    rows = reduce(DataFrame.unionByName, located)
    return (
        rows.join(metadata.select("doc_id", "page_count"), "doc_id")
        .where(F.col("page_number").between(1, F.col("page_count")))
        .select("src", page_node().alias("dst"), F.lit("appears_in").alias("edge_type"), "doc_id", "step")
    )


@prepared
def build_edges(
    metadata: DataFrame, elements: DataFrame, tables: DataFrame, figures: DataFrame,
    equations: DataFrame, references: DataFrame, citations: DataFrame,
) -> DataFrame:
    """All edges (src, dst, edge_type, doc_id, step); ``step`` is the order of construction."""

    def edge(df: DataFrame, src: Column, dst: Column, kind: str, step: int) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), "doc_id", F.lit(step).alias("step"))

    section = F.col("element_type").isin(fixed.SECTION_TYPES)
    placed = scans.running_last(
        elements.select("doc_id", "pos", "element_type"), ["doc_id"], ["pos"], {"section_pos": F.when(section, F.col("pos"))}
    )
    authors = metadata.select("doc_id", F.explode("authors").alias("author"))
    pages = metadata.where("page_count >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"))
    parts = [
        edge(authors, doc_node(), author_node(F.col("author")), "authored_by", 2).distinct(),
        edge(pages, doc_node(), page_node(), "contains", 3),
        edge(elements.where(section), doc_node(), element_node(), "contains", 4),
        edge(placed.where(~section & F.col("section_pos").isNotNull()), element_node("section_pos"), element_node(), "contains", 4),
        edge(tables, doc_node(), entity_node("table"), "contains", 5),
        edge(figures, doc_node(), entity_node("figure"), "contains", 6),
        edge(equations, doc_node(), entity_node("equation"), "contains", 7),
        edge(references, doc_node(), entity_node("reference"), "contains", 8),
        page_edges(metadata, elements, {"table": tables, "figure": figures, "equation": equations, "citation": citations}),
        edge(citations.where("reference_id is not null"), entity_node("citation"), entity_node("reference"), "references", 8),
        reading_order_edges(elements),
    ]
    return reduce(DataFrame.unionByName, parts)


def single_edge_mode(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): the type built last wins, as in a simple directed graph."""
    return edges.groupBy("src", "dst").agg(F.max_by("edge_type", "step").alias("edge_type"), F.max("step").alias("step"))


# --- queries -----------------------------------------------------------------------------------


def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def search_nodes(
    nodes: DataFrame, query: str, node_type: str | None = None, fields: list[str] | None = None
) -> DataFrame:
    """Nodes with the text inside one of their fields, ignoring case."""
    hit = reduce(
        lambda a, b: a | b,
        [F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(query.lower())) for f in (fields or SEARCH_FIELDS)],
    )
    found = nodes.where(hit)
    return found if node_type is None else found.where(F.col("node_type") == node_type)


def gram_index(nodes: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(gram, node_id): the runs of one to GRAM characters, in lower case, that occur in a node's fields, each once.

    Store it to answer any number of searches. A field's runs do not cross into the next one.
    """
    fields = fields or SEARCH_FIELDS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *texts = [c.to_pylist() for c in batch.columns]
            for at in range(0, len(ids), 256):
                grams = [{t[i : i + n] for t in own if t for n in range(1, GRAM + 1) for i in range(len(t) - n + 1)} for own in zip(*[c[at : at + 256] for c in texts])]
                names = [ids[at + k] for k, own in enumerate(grams) for _ in own]
                yield pa.RecordBatch.from_arrays([pa.array([g for own in grams for g in own], pa.string()), pa.array(names, pa.string())], ["gram", "node_id"])

    return nodes.select("node_id", *[F.lower(f).alias(f) for f in fields]).mapInArrow(rows, "gram string, node_id string")


def search_many(nodes: DataFrame, index: DataFrame, searches: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(search_id, node columns): for each of the searches (search_id, text) what search_nodes() finds.

    Of the runs of characters that a search consists of, the one of fewest nodes
    names the candidates, and the fields of those decide; nodes without it are never read for that
    search. A search of a run that no node has finds nothing, nor does an empty one.
    """
    asked = searches.select("search_id", F.lower("text").alias("_text")).where(F.length("_text") > 0)
    size = F.least(F.length("_text"), F.lit(GRAM))
    at = F.explode(F.sequence(F.lit(1), F.length("_text") - size + 1))
    grams = asked.select("search_id", "_text", size.alias("_size"), at.alias("_at")).select("search_id", "_text", F.expr("substring(_text, _at, _size)").alias("gram")).distinct()
    wanted = grams.select("gram").distinct()
    found = index.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_n"))
    # a run that occurs nowhere counts as none and comes first
    rare = grams.join(found, "gram", "left").groupBy("search_id", "_text").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_r"))
    candidates = rare.where("_r.n > 0").select("search_id", "_text", F.col("_r.gram").alias("gram")).join(index, "gram").drop("gram")
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(f, F.lit(""))), F.col("_text")) for f in (fields or SEARCH_FIELDS)])
    return candidates.join(nodes, "node_id").where(hit).select("search_id", *nodes.columns)


def search_each(
    nodes: DataFrame, searches: DataFrame, fields: list[str] | None = None, keep: list[str] | None = None, cell: int = 4096, block: int = 512
) -> DataFrame:
    """(search_id, node columns, those in ``keep`` if given): what search_many() finds, without an index of all runs of characters.

    Nodes are dealt into cells and searches into blocks of bounded size, and every cell meets
    every block. A task looks up only the runs of its block's searches in the
    nodes of its cell; of a search's runs the one of fewest nodes names its candidates.
    """
    fields, keep = fields or SEARCH_FIELDS, keep or nodes.columns
    asked = searches.select("search_id", F.lower("text").alias("_text")).where(F.length("_text") > 0)
    cells, blocks = (max(1, -(-df.count() // size)) for df, size in ((nodes, cell), (asked, block)))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = nodes.select(*keep, *[F.lower(f).alias(f"_{f}") for f in fields], F.pmod(F.xxhash64("node_id"), F.lit(cells)).cast("int").alias("_cell"), number(blocks).alias("_block"))
    sent = asked.select("search_id", "_text", number(cells).alias("_cell"), F.pmod(F.xxhash64("search_id", "_text"), F.lit(blocks)).cast("int").alias("_block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = right.column("search_id"), right.column("_text").to_pylist()
        runs = {q: {q[i : i + GRAM] for i in range(max(1, len(q) - GRAM + 1))} for q in set(texts)}
        holders: dict[str, list[int]] = {g: [] for own in runs.values() for g in own}
        sizes = sorted({len(g) for g in holders})
        rows = [[t for t in own if t] for own in zip(*[left.column(f"_{f}").to_pylist() for f in fields])]
        for k, own in enumerate(rows):
            for g in holders.keys() & {t[i : i + n] for t in set(own) for n in sizes for i in range(len(t) - n + 1)}:
                holders[g].append(k)
        found = {}
        for q, own in runs.items():
            few = min((holders[g] for g in own), key=len)
            found[q] = np.array(few if len(q) <= GRAM else [k for k in few if any(q in t for t in rows[k])], np.int64)
        at = np.concatenate([found[q] for q in texts] or [np.empty(0, np.int64)])
        which = np.repeat(np.arange(len(texts)), [len(found[q]) for q in texts])
        return pa.table([ids.take(pa.array(which)), *[left.column(c).take(pa.array(at)) for c in keep]], ["search_id", *keep])

    key = ["_cell", "_block"]
    schema = StructType([searches.schema["search_id"], *nodes.select(*keep).schema.fields])
    return dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(meet, schema)


@prepared
def neighbors(edges: DataFrame, seeds: DataFrame, edge_type: str | None = None, direction: str = "both") -> DataFrame:
    """Distinct (node_id, neighbor) for the seed nodes; direction is out, in or both."""
    kept = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    out = kept.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor"))
    in_ = kept.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbor"))
    pairs = {"out": out, "in": in_}.get(direction) if direction != "both" else out.unionByName(in_)
    return pairs.join(seeds.select("node_id").distinct(), "node_id", "left_semi").distinct()


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (node_id)."""
    ids = members.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@prepared
def k_hop_each(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Per seed: (seed, node_id, hops) within k steps ignoring direction, and (seed, edge columns) among them.

    Unknown seeds give nothing. Each round joins only the new frontier of
    (seed, node); frontiers are checkpointed, so a round never repeats the ones before it.
    """
    links = _both_ways(edges).distinct()
    start = nodes.select("node_id").join(seeds.select("node_id").distinct(), "node_id", "left_semi")
    frontier = cut_lineage(start.select(F.col("node_id").alias("seed"), "node_id"))
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, k + 1):
        reached = links.join(frontier.withColumnRenamed("node_id", "src"), "src").select("seed", F.col("dst").alias("node_id")).distinct()
        frontier = cut_lineage(reached.join(seen, ["seed", "node_id"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    ends = seen.select("seed", "node_id")
    inside = edges.join(ends.withColumnRenamed("node_id", "src"), "src").join(ends.withColumnRenamed("node_id", "dst"), ["seed", "dst"], "left_semi")
    return seen, inside.select("seed", *edges.columns)


def k_hop_nodes(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """(node_id, hops) within k steps of any of the seeds."""
    return k_hop_each(nodes, edges, seeds, k)[0].groupBy("node_id").agg(F.min("hops").alias("hops"))


def k_hop(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within k hops of any of the seeds and the directed edges among them."""
    members = k_hop_nodes(nodes, edges, seeds, k)
    return members, induced(edges, members)


@prepared
def shortest_paths(
    nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """Directed shortest path per (source, target): path array and hops; no row when there is none.

    Breadth first for all pairs together, from both ends: a round takes a step
    forward from the sources and one backward from the targets in one job, so a way of n edges
    takes n/2 rounds and no frontier row carries more than half of it. A pair leaves the search when its
    frontiers meet or one of them ends; a node is expanded once per pair and side, and among
    equally short ways the smallest path is kept.
    """
    key = ["source", "target"]
    ids = nodes.select("node_id").distinct()
    open_ = pairs.select(*key).distinct()
    for end in key:
        open_ = open_.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    forward = edges.select(F.lit(0).alias("side"), F.col("src").alias("node"), F.col("dst").alias("next"))
    links = forward.unionByName(edges.select(F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("src").alias("next"))).distinct()
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("node")), F.struct(F.lit(1).alias("side"), F.col("target").alias("node")))).alias("s")
    start = cut_lineage(open_.select(*key, sides).select("s.side", *key, "s.node", F.array("s.node").alias("path")))
    found = start.where("side = 0 and node = target").select(*key, "path")
    frontier = seen = start.where("source <> target")

    def meeting(ahead: DataFrame, behind: DataFrame) -> DataFrame:
        """Ways through a node that both frontiers hold."""
        back = behind.where("side = 1").select(*key, "node", F.expr("slice(path, 2, size(path))").alias("_rest"))
        return ahead.where("side = 0").join(back, [*key, "node"]).select(*key, F.concat("path", "_rest").alias("path"))

    rounds = 0
    while max_hops is None or 2 * rounds < max_hops:
        rounds += 1
        longer = F.when(F.col("side") == 0, F.concat("path", F.array("next"))).otherwise(F.concat(F.array("next"), "path"))
        step = frontier.join(links, ["side", "node"]).groupBy("side", *key, "next").agg(F.min(longer).alias("path")).withColumnRenamed("next", "node")
        reached = cut_lineage(step.join(seen.select("side", *key, "node"), ["side", *key, "node"], "left_anti").select(*frontier.columns))
        # an odd number of edges meets the targets' old frontier, an even one their new one
        ways = meeting(reached, frontier).unionByName(meeting(reached, reached))
        met = cut_lineage(ways.groupBy(*key).agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("w")).select(*key, "w.path"))
        found = found.unionByName(met)
        both = reached.groupBy(*key).agg(F.count_distinct("side").alias("n")).where("n = 2")
        frontier = reached.join(both.select(*key), key, "left_semi").join(met.select(*key), key, "left_anti")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(reached)
    hops = F.size("path") - 1
    found = found.select(*key, "path", hops.alias("hops"))
    return found if max_hops is None else found.where(F.col("hops") <= max_hops)


@prepared
def all_simple_paths(edges: DataFrame, pairs: DataFrame, max_length: int = 5) -> DataFrame:
    """All directed paths without repeated nodes of at most ``max_length`` edges.

    A backward sweep first finds, per target, the edges that lead to it in the hops left. The
    forward search joins these few only, so all edges are read once for each hop, and it only builds prefixes of results.
    """
    links = edges.select("src", "dst")
    wanted = cut_lineage(pairs.select("source", "target").distinct().where("source <> target"))
    frontier = seen = cut_lineage(wanted.select("target", F.col("target").alias("node")).distinct().withColumn("left", F.lit(0)))
    ways = None
    for hop in range(1, max_length + 1):
        back = frontier.join(links, F.col("node") == F.col("dst")).select("target", "src", "dst", "left").distinct()
        if hop == max_length:  # so far away only sources lie at the right place
            back = back.join(wanted.withColumnRenamed("source", "src"), ["target", "src"], "left_semi")
        back = cut_lineage(back)
        ways = back if ways is None else ways.unionByName(back)
        if hop < max_length:
            reached = back.select("target", F.col("src").alias("node")).distinct()
            frontier = cut_lineage(reached.join(seen, ["target", "node"], "left_anti").withColumn("left", F.lit(hop)))
            seen = seen.unionByName(frontier)
    grown = wanted.select("source", "target", F.col("source").alias("src"), F.array("source").alias("path"))
    results = []
    for hop in range(1, max_length + 1):
        step = grown.join(ways.where(F.col("left") <= max_length - hop), ["target", "src"]).where(~F.array_contains("path", F.col("dst")))
        step = cut_lineage(step.select("source", "target", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path")))
        grown = step.where("src <> target")
        results.append(step.where("src = target").select("source", "target", "path"))
    return reduce(DataFrame.unionByName, results)


def _least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers below n that each one is linked with, directly or not."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _local_components(edges: DataFrame, size: int) -> DataFrame:
    """(node, label) of each run of ``size`` edges of a partition: the nodes with the smallest one that these edges link them with."""

    def stars(table: pa.Table) -> pa.RecordBatch:
        ends = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks], pa.string()).combine_chunks()
        coded = ends.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        code = rank[coded.indices.to_numpy(zero_copy_only=False)]
        label = _least_labels(code[: len(table)], code[len(table) :], len(names))
        return pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["node", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield stars(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield stars(pa.Table.from_batches(held))

    return edges.mapInArrow(run, "node string, label string")


@prepared
def connected_components(nodes: DataFrame, edges: DataFrame, run: int = 1 << 18) -> DataFrame:
    """(node_id, component) of the undirected graph; the component is its smallest node id.

    Runs of a bounded number of edges, those of one document together where
    edges name it, are contracted inside their tasks. Nodes in several runs
    link the smallest nodes of these; only such links go through alternating large-star and
    small-star contraction: a logarithmic number of rounds even for long chains.
    Each star is a map-side aggregated minimum and one join, so a hub is never collected.
    """
    ends = edges.where("src <> dst")
    if "doc_id" in edges.columns:
        ends = ends.select("doc_id", "src", "dst").repartition("doc_id").sortWithinPartitions("doc_id")
    pairs = cut_lineage(_local_components(ends.select("src", "dst"), run))
    known = nodes.select(F.col("node_id").alias("node"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("known"))
    homes = cut_lineage(pairs.withColumn("known", F.lit(False)).unionByName(known).groupBy("node").agg(
        F.min("label").alias("m"), F.max("label").alias("last"), F.bool_or("known").alias("known")
    ))
    shared = homes.where("m <> last").select("node", "m")
    links = cut_lineage(pairs.join(shared, "node").where("label <> m").select(F.col("label").alias("u"), F.col("m").alias("v")).distinct())
    mark = None
    while True:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        small = below.join(least, "u")
        links = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == now:
            break
        mark = now
    labels = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "m")
    return homes.where("known").join(labels, "m", "left").select(
        F.col("node").alias("node_id"), F.coalesce("component", "m", "node").alias("component")
    )


def extract_subgraph(
    nodes: DataFrame, edges: DataFrame, node_types: list[str] | None = None, edge_types: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep node types (dropping dangling edges), then edge types (keeping nodes)."""
    if node_types:
        nodes = nodes.where(F.col("node_type").isin(node_types))
        edges = induced(edges, nodes)
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    return nodes, edges


def citation_network(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return extract_subgraph(nodes, edges, ["citation", "reference"], ["references"])


@prepared
def page_subgraph(edges: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per page (column page_id): the page with the nodes that appear in it, and the edges among them."""
    wanted = pages.select("page_id").distinct()
    on_page = edges.where(F.col("edge_type") == "appears_in").join(wanted, F.col("dst") == F.col("page_id")).select(
        "page_id", F.col("src").alias("node_id")
    )
    members = wanted.select("page_id", F.col("page_id").alias("node_id")).unionByName(on_page).distinct()
    inside = (
        edges.join(members.withColumnRenamed("node_id", "src"), "src")
        .join(members.withColumnRenamed("node_id", "dst"), ["page_id", "dst"], "left_semi")
        .select("page_id", "src", "dst", "edge_type")
    )
    return members, inside


@prepared
def section_content(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, node_id, depth) of everything a section contains, directly or further down.

    Nodes already collected for a section are not expanded again, so shared
    content appears once, cycles end, and the rounds go on until nothing is left.
    """
    links = edges.where(F.col("edge_type") == "contains").select("src", "dst").distinct()
    frontier = sections.select(F.col("node_id").alias("section_id"), "node_id").distinct()
    seen, depth = None, 1
    while True:
        step = frontier.join(links, F.col("node_id") == F.col("src")).select("section_id", F.col("dst").alias("node_id")).distinct()
        if seen is not None:
            step = step.join(seen, ["section_id", "node_id"], "left_anti")
        frontier = cut_lineage(step)
        level = frontier.withColumn("depth", F.lit(depth))
        seen = level if seen is None else seen.unionByName(level)
        if frontier.isEmpty():
            return seen
        if depth % 16 == 0:  # keeps the plan of deep graphs short
            seen = cut_lineage(seen)
        depth += 1


@prepared
def graph_stats(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Summary as (metric, name, value): totals, counts per type, density, number of components."""

    def counted(df: DataFrame, column: str, metric: str) -> DataFrame:
        return df.groupBy(F.coalesce(column, F.lit("unknown")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(
            F.lit(metric).alias("metric"), "name", "value"
        )

    per_type = counted(nodes, "node_type", "node_type").unionByName(counted(edges, "edge_type", "edge_type"))
    total = per_type.agg(
        F.sum(F.when(F.col("metric") == "node_type", F.col("value"))).alias("n"),
        F.coalesce(F.sum(F.when(F.col("metric") == "edge_type", F.col("value"))), F.lit(0.0)).alias("m"),
    )
    density = F.when(F.col("n") > 1, F.round(F.col("m") / (F.col("n") * (F.col("n") - 1)), 6)).otherwise(F.lit(0.0))
    totals = total.select(F.explode(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit("").alias("name"), value.alias("value"))
        for metric, value in [("total_nodes", F.col("n")), ("total_edges", F.col("m")), ("density", density)]
    ])).alias("s")).select("s.*")
    out = per_type.unionByName(totals)
    if components is not None:
        # the smallest node of a component is the one whose label is itself, so no distinct is needed
        n = components.where("node_id = component").agg(F.count("*").cast("double").alias("value"))
        out = out.unionByName(n.select(F.lit("connected_components").alias("metric"), F.lit("").alias("name"), "value"))
    return out


def document_graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and density of each document's own graph; its authors count as its nodes."""
    own = nodes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("own"))
    per_edges = edges.groupBy("doc_id").agg(
        F.count("*").alias("n_edges"), F.sum((F.col("edge_type") == "authored_by").cast("bigint")).alias("authors")
    )
    n = F.col("n_nodes")
    return own.join(per_edges, "doc_id", "left").select(
        "doc_id", (F.col("own") + F.coalesce("authors", F.lit(0))).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges")
    ).withColumn("density", F.when(n > 1, F.round(F.col("n_edges") / (n * (n - 1)), 6)).otherwise(0.0))


def entity_preview(elements: DataFrame, tables: DataFrame, figures: DataFrame, equations: DataFrame) -> DataFrame:
    """First four headings, tables and figures and three equations of each document, with short labels."""
    from quire.operators.answers import first_k

    def short(text: Column, n: int) -> Column:
        return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)

    def node(df: DataFrame, kind: str, limit: int, label: Column) -> DataFrame:
        return first_k(df, limit).select("doc_id", F.lit(kind).alias("node_type"), F.col("k"), label.alias("label"), "page_number")

    k = F.col("k").cast("string")
    captioned = lambda word: F.when(F.length("caption") > 0, short(F.col("caption"), 35)).otherwise(F.concat(F.lit(word), k))
    raw = F.when(F.length("raw_text") > 0, short(F.col("raw_text"), 25)).otherwise(F.concat(F.lit("Formula "), k))
    ordered = equations.withColumn("pos", F.struct("pos", "source_order", "match_pos"))
    heading = F.when(F.length("content") > 0, F.col("content")).otherwise(F.concat(F.lit("Section "), k))
    return reduce(DataFrame.unionByName, [
        node(elements.where(F.col("element_type").isin("heading", "subheading")), "section", 4, heading),
        node(tables, "table", 4, captioned("Table ")),
        node(figures, "figure", 4, captioned("Figure ")),
        node(ordered, "equation", 3, F.concat(F.lit("Equation ("), k, F.lit("): "), raw)),
    ])
