"""Nearest-neighbour search with filters, fallbacks and per-intent plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import classify, ngrams
from quire.functions import text as T
from quire.operators.embedding import embed_queries
from quire.session import cut_lineage, prepared

RANK_DIGITS = 12  # scores closer than that differ by rounding errors only
CELL_ROWS = 20_000
BLOCK_ROWS = 512
_HITS = "query_id bigint, id string, score double"


def valid_queries(queries: DataFrame, text_col: str = "query", k_col: str = "k") -> DataFrame:
    """Questions that are not blank and ask for 1 to 50 hits."""
    return queries.where((F.length(T.strip(F.col(text_col))) > 0) & F.col(k_col).between(1, 50))


def _keep_best(queries: DataFrame, hits: DataFrame, k: Column) -> DataFrame:
    """The k best per query by (score, id); Spark limits groups before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(best))
    if "k" in queries.columns:
        return ranked.join(queries.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")).drop("k")
    return ranked.where(F.col("rank") <= k)


@prepared
def knn_topk(
    queries: DataFrame, index: DataFrame, k: int = 10, id_col: str = "chunk_id", scope: DataFrame | None = None, idf: np.ndarray | None = None
) -> DataFrame:
    """Exact cosine top k: (query_id, id, score, rank).

    A ``k`` column on the queries overrides ``k``; a ``first_type`` column that
    is not null restricts a question to chunks of that ``chunk_type``; with a
    ``scope`` (query_id, doc_id) a question sees chunks of its own documents only.

    Questions stay distributed: index rows are dealt into cells of about
    CELL_ROWS, every question goes to every cell (with a scope, to those that hold documents of its), and
    a task answers them in blocks of BLOCK_ROWS with a matrix product and a mask of documents
    each. It sends on its own best k per
    question only. Ranking is by the score up to rounding errors (12 digits); ties go to the smaller id.
    With ``idf`` the index has sparse counts (`buckets`, `counts`) instead of vectors; these are dealt out, and weighted in the task.
    """
    limit = F.col("k").cast("int") if "k" in queries.columns else F.lit(k)
    wanted = F.col("first_type") if "first_type" in queries.columns else F.lit(None).cast("string")
    kind = F.col("chunk_type") if "chunk_type" in index.columns else F.lit(None).cast("string")
    usable = index.where(F.col("embedding" if idf is None else "buckets").isNotNull())
    cells = max(1, -(-usable.count() // CELL_ROWS))
    asked = queries.where(F.col("embedding").isNotNull())
    none = F.lit(None)
    if scope is None:
        usable = usable.withColumn("_cell", F.pmod(F.xxhash64(F.col(id_col)), F.lit(cells)).cast("int"))
        asked = asked.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("_docs", none.cast("array<string>"))
    else:
        # the chunks of a document share a cell, unless there are more than a cell takes
        large = usable.groupBy("doc_id").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_parts")).where("_parts > 1")

        def cell(part: Column) -> Column:
            return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), part), F.lit(cells)).cast("int")

        usable = usable.join(large, "doc_id", "left").withColumn("_cell", cell(F.pmod(F.xxhash64(F.col(id_col)), F.coalesce("_parts", F.lit(1))).cast("int")))
        spread = scope.select("query_id", "doc_id").distinct().join(large, "doc_id", "left")
        spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        spread = spread.groupBy("query_id", cell(F.col("_part")).alias("_cell")).agg(F.collect_set(F.col("doc_id").cast("string")).alias("_docs"))
        asked = asked.join(spread, "query_id")
    doc = F.col("doc_id").cast("string") if scope is not None else none.cast("string")
    vector = F.col("embedding").cast("array<double>").alias("vector")
    sparse = [] if idf is None else ["buckets", "counts"]
    rows = usable.select(
        F.col("_cell").alias("cell"), F.lit(0).alias("side"), none.cast("bigint").alias("query_id"),
        F.lit(0).alias("k"), F.col(id_col).cast("string").alias("id"), kind.alias("type"), none.cast("array<double>").alias("vector") if sparse else vector,
        doc.alias("doc"), none.cast("array<string>").alias("docs"), *sparse,
    )
    asked = asked.select(
        F.col("_cell").alias("cell"), F.lit(1).alias("side"), F.col("query_id").cast("bigint").alias("query_id"),
        limit.alias("k"), none.cast("string").alias("id"), wanted.alias("type"), vector,
        none.cast("string").alias("doc"), F.col("_docs").alias("docs"), *[none.cast("array<int>").alias(c) for c in sparse],
    )
    tiles = rows.unionByName(asked).repartition(cells, "cell").sortWithinPartitions("cell", "side", "query_id", "id")
    return _keep_best(queries, tiles.mapInArrow(lambda batches: _tile_hits(batches, idf), _HITS), F.lit(k))


def _units(vectors: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each vector at length one (a zero vector stays as it is), and which ones have no null component (one with any takes no part)."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(vectors)), lengths)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    whole = np.ones(len(vectors), bool)
    whole[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    size = np.sqrt(np.bincount(owner, weights=values * values, minlength=len(vectors)))
    size[size == 0] = 1.0
    return np.split(values / size[owner], np.cumsum(lengths)[:-1]), whole


def _weighted_units(buckets: pa.ListArray, counts: pa.ListArray, idf: np.ndarray) -> list[np.ndarray | None]:
    """The vector of unit length of each row's counts; none for a row without counts, zero for one of an empty text."""
    length = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, place = np.repeat(np.arange(len(buckets)), length), buckets.flatten().to_numpy(zero_copy_only=False)
    dense = np.zeros((len(buckets), len(idf)))
    dense[row, place] = ngrams.scaled(counts.flatten().to_numpy(zero_copy_only=False), place, row, len(buckets), idf)
    return [v if known else None for v, known in zip(dense, buckets.is_valid().to_pylist())]


def _tile_hits(batches: Iterator[pa.RecordBatch], idf: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Best hits per question of each cell; a cell's index rows come first, its questions in blocks after."""
    cell, held, parts, number_of = None, [], {}, {}

    def part(size: int, kind: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        if (size, kind) not in parts:
            own = [r for r in held if len(r[2]) == size and kind in (None, r[1])]
            codes = np.array([number_of.setdefault(r[3], len(number_of)) for r in own], np.int64)
            parts[size, kind] = [r[0] for r in own], np.array([r[2] for r in own]).reshape(-1, size), codes
        return parts[size, kind]

    def answer(asked: list[tuple]) -> pa.RecordBatch:
        out = []
        for size, kind in {(len(a[3]), a[2]) for a in asked}:
            ids, matrix, codes = part(size, kind)
            block = [a for a in asked if len(a[3]) == size and a[2] == kind]
            # the bitmap of documents that each question of the block may see
            seen = np.zeros((len(block), len(number_of)), bool)
            for row, a in enumerate(block):
                if a[4] is None:
                    seen[row] = True
                else:
                    seen[row, [number_of[d] for d in a[4] if d in number_of]] = True
            scores = np.round(np.array([a[3] for a in block]) @ matrix.T, RANK_DIGITS) + 0.0
            for (query, k, *_), own, mine in zip(block, scores, seen):
                inside = np.flatnonzero(mine[codes])
                own = own[inside]
                keep = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
                # ids are in ascending order, so a stable sort gives ties to the smaller one
                keep = keep[np.argsort(-own[keep], kind="stable")][:k]
                out += [(query, ids[inside[i]], own[i]) for i in keep]
        kinds = (pa.int64(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["query_id", "id", "score"])

    for batch in batches:
        asked: list[tuple] = []
        if not batch.num_rows:
            continue
        place = batch.schema.get_field_index("vector")
        # vectors stay numpy: slices of the column's values, never lists of numbers
        vectors, whole = _units(batch.column(place))
        if idf is not None:
            own = _weighted_units(*[batch.column(batch.schema.get_field_index(c)) for c in ("buckets", "counts")], idf)
            vectors = [v if w is None else w for v, w in zip(vectors, own)]
        for usable, (number, side, query, k, name, kind, unit, doc, docs) in zip(whole.tolist(), zip(*[vectors if i == place else c.to_pylist() for i, c in enumerate(batch.columns[:9])])):
            if number != cell:
                if asked:
                    yield answer(asked)
                cell, held, parts, number_of, asked = number, [], {}, {}, []
            if not usable:
                continue
            if side == 0:
                held.append((name, kind, unit, doc))
                continue
            asked.append((query, k, kind, unit, docs))
            if len(asked) == BLOCK_ROWS:
                yield answer(asked)
                asked = []
        if asked:
            yield answer(asked)


def knn_in_scope(
    queries: DataFrame, index: DataFrame, scope: DataFrame, k: int = 10, mode: str = "exact", id_col: str = "chunk_id", idf: np.ndarray | None = None
) -> DataFrame:
    """Top k where each query names its documents: scope(query_id, doc_id). Queries that name none see all.

    Filtered before ranking, or (mode='oversample') among the best 5k of all documents.
    """
    named = scope.select("query_id").distinct()
    if mode == "exact":
        free = knn_topk(queries.join(named, "query_id", "left_anti"), index, k, id_col, idf=idf)
        return free.unionByName(knn_topk(queries.join(named, "query_id", "left_semi"), index, k, id_col, scope, idf))
    # one scan answers both kinds of questions, each with its own number of hits
    asked = queries.join(named.withColumn("_own", F.lit(True)), "query_id", "left")
    if "k" not in queries.columns:
        asked = asked.withColumn("k", F.when(F.col("_own"), 5 * k).otherwise(k))
    hits = cut_lineage(knn_topk(asked, index, k, id_col, idf=idf))
    free = hits.join(named, "query_id", "left_anti")
    wide = hits.join(named, "query_id", "left_semi").drop("rank").join(index.select(F.col(id_col).cast("string").alias("id"), "doc_id"), "id")
    seen = wide.join(scope.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").drop("doc_id")
    return free.unionByName(_keep_best(queries, seen, F.lit(k)).select(*free.columns))


def restrict_documents(index: DataFrame, doc_ids: DataFrame | None) -> DataFrame:
    """Chunks of the listed documents; no list means no filter."""
    return index if doc_ids is None else index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def knn_by_type(
    queries: DataFrame, index: DataFrame, chunk_type: str, k: int = 3, oversample: bool = False, id_col: str = "chunk_id"
) -> DataFrame:
    """Top k among chunks of one type.

    With ``oversample`` the best 5k of all types are fetched first and filtered
    after, which can return fewer than k.
    """
    if not oversample:
        return knn_topk(queries, index.where(F.col("chunk_type") == chunk_type), k, id_col)
    wide = knn_topk(queries, index, 5 * k, id_col)
    typed = index.where(F.col("chunk_type") == chunk_type).select(F.col(id_col).cast("string").alias("id"))
    return _keep_best(queries, wide.drop("rank").join(typed, "id", "left_semi"), F.lit(k))


def knn_postfilter(
    queries: DataFrame, index: DataFrame, doc_ids: DataFrame, k: int = 10, mode: str = "exact", id_col: str = "chunk_id"
) -> DataFrame:
    """Top k within a document list: filtered before ranking, or (mode='oversample') among the best 5k."""
    if mode == "exact":
        return knn_topk(queries, restrict_documents(index, doc_ids), k, id_col)
    wide = knn_topk(queries, index, 5 * k, id_col).drop("rank")
    allowed = restrict_documents(index, doc_ids).select(F.col(id_col).cast("string").alias("id"))
    return _keep_best(queries, wide.join(allowed, "id", "left_semi"), F.lit(k))


@prepared
def search_fallback(
    queries: DataFrame, index: DataFrame, k: int = 5, scope: DataFrame | None = None, mode: str = "exact", idf: np.ndarray | None = None
) -> DataFrame:
    """Search; questions without hits are retried cleaned, then (if they name documents) as a general overview.

    Returns (query_id, id, score, rank, attempt). ``scope`` (query_id, doc_id) holds the documents
    that questions name. With mode='oversample' the scope is applied to the best 5k of all documents, as
    a flat index does it, so a question can find nothing although its documents have chunks.

    All forms of all questions are asked at once, so the index is dealt out once, and of a question the first form with hits
    counts. Where the scope does not decide what is scanned, equal texts are asked once. ``idf``: see knn_topk.
    """
    asked = queries.select("query_id", "query")
    forms = asked.withColumn("attempt", F.lit(1)).unionByName(
        asked.withColumn("query", classify.clean_query(F.col("query"))).where(F.length("query") >= 3).withColumn("attempt", F.lit(2))
    )
    if scope is not None:
        scope = scope.select("query_id", "doc_id").distinct()
        named = cut_lineage(scope.select("query_id").distinct())
        overview = asked.join(named, "query_id", "left_semi").withColumn("query", F.lit(fixed.OVERVIEW_QUESTION))
        forms = forms.unionByName(overview.withColumn("attempt", F.lit(3)))
    # numbers stay as they are once they are stored
    forms = cut_lineage(forms.withColumn("_form", F.monotonically_increasing_id()))
    if scope is not None and mode == "exact":
        vectors = cut_lineage(embed_queries(forms.select(F.col("_form").alias("query_id"), "query")))
        own = scope.join(forms.select("query_id", "_form"), "query_id").select(F.col("_form").alias("query_id"), "doc_id")
        hits = knn_in_scope(vectors, index, own, k, idf=idf).withColumnRenamed("query_id", "_form").join(forms.drop("query"), "_form")
    else:
        texts = cut_lineage(forms.select("query").distinct().withColumn("query_id", F.monotonically_increasing_id()))
        vectors = cut_lineage(embed_queries(texts))
        found = knn_topk(vectors, index, k if scope is None else 5 * k, idf=idf).withColumnRenamed("query_id", "_text")
        hits = cut_lineage(found.join(texts.withColumnRenamed("query_id", "_text"), "_text").join(forms, "query"))
        if scope is not None:
            free = hits.join(named, "query_id", "left_anti").where(F.col("rank") <= k)
            wide = hits.join(named, "query_id", "left_semi").join(index.select(F.col("chunk_id").cast("string").alias("id"), "doc_id"), "id")
            seen = wide.join(scope, ["query_id", "doc_id"], "left_semi").withColumn(
                "rank", F.row_number().over(Window.partitionBy("_form").orderBy(F.desc("score"), "id"))
            )
            hits = free.unionByName(seen.where(F.col("rank") <= k).select(*free.columns))
    first = F.min("attempt").over(Window.partitionBy("query_id"))
    return hits.withColumn("_first", first).where("attempt = _first").select("query_id", "id", "score", "rank", "attempt")


@prepared
def retrieval_plan(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Hits per question by intent: how many, of which chunk type first, and what when there is none.

    Returns (query_id, intent, id, score, rank).
    """
    plan = F.col("intent")

    def pick(position: int) -> Column:
        chain = F.when(F.lit(False), F.lit(None))
        for row in fixed.RETRIEVAL_PLAN:
            chain = chain.when(plan == row[0], F.lit(row[position]))
        return chain

    planned = queries.withColumn("intent", classify.intent(F.col("query"))).select(
        "query_id", "intent",
        classify.augment_query(F.col("query"), F.col("intent")).alias("query"),
        pick(1).cast("int").alias("k"), pick(2).cast("string").alias("first_type"), pick(3).cast("int").alias("fallback_k"),
    )
    vectors = cut_lineage(embed_queries(planned))
    hits = cut_lineage(knn_topk(vectors, index))  # a few rows per question, used twice
    rest = cut_lineage(vectors.where(F.col("first_type").isNotNull()).join(hits, "query_id", "left_anti").drop("k", "first_type"))
    if not rest.isEmpty():  # else the index would be read and dealt out again for nothing
        hits = hits.unionByName(knn_topk(rest.withColumnRenamed("fallback_k", "k"), index))
    return hits.join(planned.select("query_id", "intent"), "query_id")


def format_context(hits: DataFrame, chunks: DataFrame, include_metadata: bool = True) -> DataFrame:
    """One context block per question: ranked sources with document, page, type and section.

    A question has at most 50 hits, so the ordered list per question is bounded.
    """
    c = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "page_number", "chunk_type", "section", "content")
    section = F.when(
        (F.length("section") > 0) & F.lit(include_metadata), F.concat(F.lit(" | Section="), F.col("section"))
    ).otherwise(F.lit(""))
    block = F.concat(
        F.lit("[Source "), F.col("rank"), F.lit("] Doc="), F.substring(F.col("doc_id").cast("string"), 1, 8), F.lit("… | Page="),
        F.col("page_number"), F.lit(" | Type="), F.col("chunk_type"), section, F.lit("\n"), F.col("content"),
    )
    return (
        hits.join(c, "id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
        .select(
            "query_id",
            F.array_join(F.transform("b", lambda x: x["block"]), fixed.CONTEXT_SEPARATOR).alias("context"),
        )
    )


def verify_sources(answers: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks an answer really cites; all of them when it cites none and at most two were retrieved."""
    cited = F.array_distinct(
        F.transform(F.regexp_extract_all("answer", F.lit(fixed.SOURCE_TAG), F.lit(1)), lambda n: n.try_cast("int"))
    )
    n_hits = F.count("*").over(Window.partitionBy("query_id"))
    c = chunks.select(
        F.col("chunk_id").alias("id"), "doc_id", "page_number", "section", "chunk_type", "content", "x0", "y0", "x1", "y1"
    )
    joined = hits.withColumn("_n", n_hits).join(answers.select("query_id", cited.alias("_cited")), "query_id")
    kept = joined.where(F.array_contains("_cited", F.col("rank")) | ((F.size("_cited") == 0) & (F.col("_n") <= 2)))
    return kept.join(c, "id").select(
        "query_id", F.concat(F.lit("Source "), F.col("rank")).alias("source_id"), "doc_id", "page_number",
        F.coalesce("section", F.lit("")).alias("section"), "chunk_type", "x0", "y0", "x1", "y1",
        F.substring("content", 1, 200).alias("snippet"),
    )
