"""Operators on small hand-built inputs, and against brute force in plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import classify, ngrams
from quire.functions import text as T
from quire.operators import chunking, citations, embedding, equations, graph, layout, recognition, scans, search, sections
from quire.sources import documents as D
from quire.sources import index as ix
from quire.streaming import ingest

ELEMENT = "doc_id long, pos int, page_number int, reading_order int, element_type string, content string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean"


def make(spark, rows):
    """rows of (pos, page, type, content, y0, y1, font)"""
    out = []
    for pos, page, etype, content, *rest in rows:
        y0, y1, font = (rest + [None] * 3)[:3]
        box = (0.1, y0, 0.9, y1) if y0 is not None else (None,) * 4
        out.append((1, pos, page, pos, etype, content, *box, font, False))
    return spark.createDataFrame(out, ELEMENT)


@pytest.fixture(scope="module")
def paper(spark):
    return make(spark, [
        (0, 1, "title", "A Paper"),
        (1, 1, "paragraph", "Transformers work well [1] and attention too, see Vaswani et al. (2017)."),
        (2, 1, "equation", "E = mc^2 (1)"),
        (3, 1, "caption", "Figure 1: Model architecture", 0.50, 0.53),
        (4, 1, "caption", "Table 1: Scores", 0.80, 0.83),
        (5, 1, "paragraph", "As before [1, 2] and (Smith, 2020)."),
        (6, 2, "references", "References"),
        (7, 2, "paragraph", "[1] Vaswani and Shazeer. Attention is all you need. NeurIPS, 2017. doi:10.5555/3295222"),
    ])


def test_citations_and_references(spark, paper):
    cites = citations.extract_citations(paper)
    refs = citations.extract_references(paper).collect()
    assert len(refs) == 1 and refs[0].ref_index == 1 and refs[0].doi == "10.5555/3295222" and refs[0].year == 2017
    assert refs[0].authors == ["Vaswani", "Shazeer"]
    linked = {r.cite_key: r.reference_id for r in citations.link_citations(cites, citations.extract_references(paper)).collect()}
    assert linked["[1]"] == refs[0].reference_id and linked["[1, 2]"] is None and linked["(Smith, 2020)"] is None
    expanded = citations.link_citations(cites, citations.extract_references(paper), expand=True).where("cite_key = '[1, 2]'").collect()
    assert {r.ref_index: r.reference_id for r in expanded} == {1: refs[0].reference_id, 2: None}


def test_surname_link(spark):
    refs = make(spark, [(0, 1, "references", "References"), (1, 1, "paragraph", "Ada Lovelace. On engines. Notes, 1843")])
    text = make(spark, [(0, 1, "paragraph", "See Lovelace (1843) and (Babbage, 1837).")])
    linked = citations.link_author_year(citations.extract_citations(text), citations.extract_references(refs)).collect()
    assert {r.cite_key: r.reference_id is not None for r in linked} == {"Lovelace (1843)": True, "(Babbage, 1837)": False}


def test_no_reference_section(spark):
    assert citations.extract_references(make(spark, [(0, 1, "paragraph", "Nothing to see here at all")])).count() == 0


def test_equations(spark, paper):
    rows = equations.extract_equations(paper).collect()
    assert [(r.raw_text, r.is_inline) for r in rows if r.pos == 2] == [("E = mc^2", False)]
    mixed = make(spark, [
        (0, 1, "caption", r"Let $a+b$ and $$c_i = d$$ hold, \begin{align}x&=1\end{align} and $a+b$ again"),
        (1, 1, "equation", ""),
    ])
    found = [(r.source_order, r.latex) for r in equations.extract_equations(mixed).orderBy("source_order", "match_pos").collect()]
    assert found == [(1, "c_i = d"), (1, "x&=1"), (2, "a+b")]


def test_captions(spark, paper):
    figures = spark.createDataFrame([(1, 1, 1, "f", 0.1, 0.30, 0.9, 0.48, None, None, None)],
                                    "doc_id long, pos long, page_number int, figure_id string, x0 double, y0 double, x1 double, y1 double, caption string, description string, figure_type string")
    got = layout.pair_figure_captions(figures, paper).first()
    assert got.caption.startswith("Figure 1") and got.figure_type == "architecture"
    tables = spark.createDataFrame([(1, 1, 1, "t", 0.1, 0.60, 0.9, 0.78, "own"), (1, 2, 9, "u", 0.1, 0.6, 0.9, 0.78, "own"), (1, 3, 1, "v", None, None, None, None, None)],
                                   "doc_id long, pos long, page_number int, table_id string, x0 double, y0 double, x1 double, y1 double, caption string")
    got = {r.table_id: r.caption for r in layout.pair_table_captions(tables, paper).collect()}
    assert got == {"t": "Table 1: Scores", "u": "own", "v": "Figure 1: Model architecture"}


def test_nearest_caption_brute_force(spark):
    rnd = random.Random(7)
    edges = [round(rnd.random(), 2) for _ in range(40)]
    caps = [(i, 1, "caption", f"c{i}", edges[i], edges[i] + 0.03) for i in range(20)]
    figs = [(1, i, 1, f"f{i}", 0.1, edges[20 + i], 0.9, edges[20 + i] + 0.1, None, None, None) for i in range(20)]
    figures = spark.createDataFrame(figs, "doc_id long, pos long, page_number int, figure_id string, x0 double, y0 double, x1 double, y1 double, caption string, description string, figure_type string")
    got = {r.figure_id: r.caption for r in layout.pair_figure_captions(figures, make(spark, caps), limit=9).collect()}
    for f in figs:
        want = min(caps, key=lambda c: (min(abs(c[4] - f[7]), abs(f[5] - c[5])), c[0]))
        assert got[f[3]] == want[3]


def test_regions(spark):
    near = make(spark, [(0, 1, "paragraph", "one", 0.10, 0.20, 11.0), (1, 1, "paragraph", "two", 0.21, 0.30, 11.0), (2, 1, "paragraph", "far", 0.60, 0.70, 11.0),
                        (3, 1, "paragraph", "head", 0.01, 0.03, 8.0), (4, 1, "paragraph", "x = f(x) + 1", 0.8, 0.85, 11.0), (5, 1, "table", "t", 0.9, 0.92, 11.0),
                        (6, 2, "paragraph", "no box")])
    regions = layout.merge_regions(layout.classify_regions(near)).orderBy("page_number", "region_ord").collect()
    assert [(r.region_type, r.n_elements) for r in regions] == [("header", 1), ("text", 2), ("text", 1), ("equation", 1), ("table", 1), ("text", 1)]


def test_region_merge_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        y0 = round(rnd.random() * 0.8, 2)
        rows.append((i, 1 + i % 3, "paragraph" if rnd.random() < 0.8 else "table", "w", y0, y0 + rnd.choice([0.02, 0.05, 0.4]), 11.0))
    want = []
    for page in (1, 2, 3):
        bottom = kind = None
        n = 0
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: (r[4], r[0])):
            region = "text" if r[2] == "paragraph" else "table"
            if kind == region and abs(r[4] - bottom) <= 0.02:
                bottom, n = max(bottom, r[5]), n + 1
            else:
                if n:
                    want.append((page, kind, n))
                kind, bottom, n = region, r[5], 1
        want.append((page, kind, n))
    got = layout.merge_regions(layout.classify_regions(make(spark, rows))).orderBy("page_number", "region_ord").collect()
    assert [(r.page_number, r.region_type, r.n_elements) for r in got] == want


def pack_by_hand(rows, limit):
    """Greedy packing of (pos, type, content) the slow way: list of position lists."""
    out, cur, fill = [], [], 0
    for pos, etype, content in rows:
        if etype == "heading":
            out.append(cur)
            cur, fill = [], 0
            continue
        size = max(1, len(content) // 4)
        if size > limit:
            out.append(cur)
            out.append([pos])
            cur, fill = [], 0
        elif cur and fill + size > limit:
            out.append(cur)
            cur, fill = [pos], size
        else:
            cur, fill = cur + [pos], fill + size
    return [c for c in out + [cur] if c]


@pytest.mark.parametrize("block", [scans.BLOCK, 16, 5])
def test_packing_in_blocks(spark, block):
    """Sections longer than a block give the same chunks as packing in one go."""
    rnd = random.Random(11)
    rows = []
    for i in range(260):
        etype = "heading" if i in (90, 91, 200) else "equation" if 120 < i < 150 else "paragraph"
        size = 500 if rnd.random() < 0.04 else rnd.randint(4, 120)
        rows.append((i, etype, "x" * size))
    df = make(spark, [(p, 1, t, c) for p, t, c in rows])
    got = sorted([int(e.split(":")[1]) for e in r.element_ids] for r in chunking.pack_chunks(df, max_tokens=60, block=block).collect())
    assert got == sorted(pack_by_hand([r for r in rows if r[1] != "equation"], 60))


def test_chunks_keep_limits_and_kinds(spark, paper):
    chunks = chunking.pack_chunks(paper).collect()
    assert [c.section for c in sorted(chunks, key=lambda c: c.first_pos)] == ["A Paper", "References"]
    assert all(c.token_count <= 512 for c in chunks)
    tables = spark.createDataFrame([(1, 1, 1, "t", "Scores", "a,b\r\n1,2", None, 2, 2)],
                                   "doc_id long, pos long, page_number int, table_id string, caption string, csv_repr string, summary string, rows int, cols int")
    assert chunking.table_chunks(tables).first().content == "Table Caption: Scores\n\nTable Data (CSV):\na,b\r\n1,2"


def test_abstract_section(spark):
    rows = make(spark, [(0, 1, "abstract", "Abstract"), (1, 1, "paragraph", "We study things.")])
    assert chunking.pack_chunks(rows).first().chunk_type == "abstract"


def test_tree(spark):
    rows = make(spark, [(0, 1, "title", "T"), (1, 1, "abstract", "A"), (2, 1, "paragraph", "p"), (3, 1, "heading", "H"), (4, 1, "subheading", "S"),
                        (5, 2, "paragraph", "q"), (6, 2, "caption", "c"), (7, 2, "heading", "H2"), (8, 2, "paragraph", "r")])
    tree = sections.section_tree(rows)
    got = {r.pos: (r.parent_pos, r.depth) for r in tree.collect()}
    assert got == {0: (None, 1), 1: (0, 2), 2: (1, 3), 3: (0, 2), 4: (3, 3), 5: (4, 4), 6: (4, 4), 7: (0, 2), 8: (7, 3)}
    depth = sections.tree_depth(tree).first()
    assert (depth.total_nodes, depth.max_depth) == (9, 4)
    assert sections.tree_sections(tree).count() == 5
    assert [r.pos for r in sections.flatten_tree(tree).collect()] == list(range(9))
    text = sections.subtree_text(tree, spark.createDataFrame([(1, 3)], "doc_id long, node_pos int")).first()
    assert text.text == "H\nS\nq\nc"


def test_running_last_across_blocks(spark):
    rows = spark.createDataFrame([(1, i, i if i % 37 == 5 else None) for i in range(300)], "doc_id long, pos int, v int")
    got = scans.running_last(rows, ["doc_id"], ["pos"], {"last": F.col("v")}, block=scans.pos_block("pos", 10)).orderBy("pos").collect()
    last = None
    for r in got:
        last = r.v if r.v is not None else last
        assert r["last"] == last


def test_next_row_across_blocks(spark):
    rows = spark.createDataFrame([(1, i) for i in range(0, 50, 3)], "doc_id long, pos int")
    got = scans.next_row(rows, ["doc_id"], ["pos"], F.col("pos"), "nxt", scans.pos_block("pos", 7)).orderBy("pos").collect()
    assert [r.nxt for r in got] == [*range(3, 50, 3), None]


def vectors(spark):
    return spark.createDataFrame([("a", 1, "text", [1.0, 0.0, 0.0, 0.0]), ("b", 2, "table", [0.0, 1.0, 0.0, 0.0]), ("z", 2, "text", [0.0, 0.0, 0.0, 0.0])],
                                 "chunk_id string, doc_id long, chunk_type string, embedding array<double>")


def test_search(spark):
    index = vectors(spark)
    q = spark.createDataFrame([(1, [2.0, 0.1, 0.0, 0.0])], "query_id long, embedding array<double>")
    hits = search.knn_topk(q, index, 2).orderBy("rank").collect()
    assert [h.id for h in hits] == ["a", "b"]
    ids = spark.createDataFrame([(2,)], "doc_id long")
    assert [h.id for h in search.knn_postfilter(q, index, ids, 1).collect()] == ["b"]
    assert [h.id for h in search.knn_by_type(q, index, "table", 1).collect()] == ["b"]
    assert search.knn_topk(q.where("query_id = 5"), index, 2).count() == 0


def test_knn_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 6)).astype(float)
    rows = [(f"c{i:03d}", 1, "text", x.tolist()) for i, x in enumerate(v)]
    index = spark.createDataFrame(rows, "chunk_id string, doc_id long, chunk_type string, embedding array<double>").repartition(7)
    qs = spark.createDataFrame([(i, v[i * 11].tolist()) for i in range(20)], "query_id long, embedding array<double>")
    got = {(h.query_id, h["rank"]): h.id for h in search.knn_topk(qs, index, 7).collect()}
    unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x
    for i in range(20):
        ranked = sorted(((-round(float(unit(v[i * 11]) @ unit(x)), 6), f"c{j:03d}") for j, x in enumerate(v)))
        assert [got[i, r + 1] for r in range(7)] == [n for _, n in ranked[:7]]


def test_search_fallback(spark):
    chunks = spark.createDataFrame([(f"k{i:02d}", i, "text", "alpha beta words") for i in range(30)] + [("m", 98, "text", "alpha other"), ("o", 99, "text", "overview methodology")],
                                   "chunk_id string, doc_id long, chunk_type string, content string")
    index = embedding.embed_chunks(chunks)
    q = spark.createDataFrame([(1, "alpha beta words"), (2, "alpha beta words"), (3, "what is the other")], "query_id long, query string")
    scope = spark.createDataFrame([(1, 99), (3, 98), (3, 98), (3, 5)], "query_id long, doc_id long")
    got = sorted((h.query_id, h.id, h["rank"], h.attempt) for h in search.search_fallback(q, index, 5, scope, mode="oversample").collect())
    assert got[:6] == [(1, "o", 1, 3), *[(2, f"k{i:02d}", i + 1, 1) for i in range(5)]]
    assert ("m", 1) in {(x[1], x[3]) for x in got[6:]}
    exact = sorted((h.query_id, h.id, h.attempt) for h in search.search_fallback(q, index, 5, scope).collect())
    assert [x for x in exact if x[0] != 2] == [(1, "o", 1), (3, "k05", 1), (3, "m", 1)]
    gone = spark.createDataFrame([(1, 12345)], "query_id long, doc_id long")
    assert {h.query_id for h in search.search_fallback(q, index, 5, gone).collect()} == {2, 3}


def test_scopes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_ROWS", 40)
    monkeypatch.setattr(search, "BLOCK_ROWS", 3)
    dice = np.random.default_rng(8)
    rows = [(f"c{i:03d}", int(i % 9 if i < 250 else 9), ["text", "table"][i % 2], dice.integers(-3, 4, 5).astype(float).tolist()) for i in range(400)]
    index = spark.createDataFrame(rows, "chunk_id string, doc_id long, chunk_type string, embedding array<double>")
    asked = [(i, dice.integers(-3, 4, 5).astype(float).tolist(), ["table", None][i % 2]) for i in range(20)]
    named = {i: set(dice.choice(12, dice.integers(1, 5), replace=False).tolist()) for i in range(0, 20, 2)}
    named[4] = {77}
    scope = spark.createDataFrame([(i, d) for i, ds in named.items() for d in ds], "query_id long, doc_id long")
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, first_type string")
    got = {}
    for h in search.knn_in_scope(queries, index, scope, 6).orderBy("query_id", "rank").collect():
        got.setdefault(h.query_id, []).append(h.id)
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    for i, v, kind in asked:
        allowed = [r for r in rows if (kind is None or r[2] == kind) and (i not in named or r[1] in named[i])]
        want = sorted((-round(float(unit(v) @ unit(r[3])), 6) + 0.0, r[0]) for r in allowed)[:6]
        assert got.get(i, []) == [n for _, n in want]


def sparse(t, dim=384):
    words = [w for w in re.findall(r"\w{2,}", t.lower())]
    code = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    return sorted(Counter([c % dim for c in code] + [(a * 31 + b) % dim for a, b in zip(code, code[1:])]).items())


def test_counts_and_weights(spark, monkeypatch):
    texts = [None, "", "a b", "One two one TWO", "Ünder_9 x１２ 東京 é!", "word " * 500, "one"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, content string, bucket string")
    for limit in (1 << 21, 5):
        monkeypatch.setattr(ngrams, "_CHARS", limit)
        got = {r.id: r for r in embedding.with_counts(df, "content").collect()}
        assert got[0].buckets is None and got[0].counts is None
        for i, t in enumerate(texts[1:], 1):
            assert list(zip(got[i].buckets, got[i].counts)) == sparse(t)
    n = sum(t is not None for t in texts)
    df_of = Counter(b for t in texts if t for b, _ in sparse(t))
    found = {r.id: r.embedding for r in embedding.tfidf_vectors(df, "content").collect()}
    assert found[0] is None and set(found[1]) == {0.0} and len(found[1]) == 384
    for i, t in enumerate(texts[1:], 1):
        raw = np.zeros(384)
        for b, c in sparse(t):
            raw[b] = c * (np.log((1 + n) / (1 + df_of[b])) + 1)
        assert np.allclose(found[i], raw / (np.linalg.norm(raw) or 1))
    weights = embedding.tfidf(df, "id", "content").collect()
    assert len(weights) == sum(len(sparse(t)) for t in texts if t) and embedding.hash_ngrams(df.limit(0), "id", "content").count() == 0


def test_batches_give_the_index_of_one(spark, tmp_path):
    """Unequal batches, a retry, documents sent again and withdrawn: the same chunks and vectors as one batch of what is left."""
    schema = ingest.DOCUMENT_SCHEMA
    doc = lambda i, t: (i, t, "en", "s", 1)
    text = lambda i: f"Title {i}\nsome words about topic{i % 4} here\n$$x_{i} = y^2$$ is shown\nFigure {i}: a line chart"
    first = spark.createDataFrame([doc(i, text(i)) for i in range(9)] + [doc(20, "Draft only\nrare words vanish"), doc(21, "To go\nsoon")], schema)
    second = spark.createDataFrame([doc(30, text(30)), doc(20, text(20)), doc(21, ""), doc(22, None)], schema)
    third = spark.createDataFrame([doc(30, text(31))], schema)
    whole = spark.createDataFrame([doc(i, text(i)) for i in range(9)] + [doc(20, text(20)), doc(30, text(31))], schema)

    def state(path):
        rows = ingest.current_index(spark, path).collect()
        assert {"chunk_id", "doc_id", "chunk_type", "content", "embedding"} <= set(rows[0].asDict())
        return {r.chunk_id: (r.content, tuple(round(x, 12) for x in r.embedding)) for r in rows}

    for batch, part in enumerate((first, second)):
        ingest.ingest_batch(part, batch, f"{tmp_path}/a")
    once = state(f"{tmp_path}/a")
    ingest.ingest_batch(second, 1, f"{tmp_path}/a")
    assert state(f"{tmp_path}/a") == once
    ingest.ingest_batch(third, 2, f"{tmp_path}/a")
    ingest.ingest_batch(third, 2, f"{tmp_path}/a")
    ingest.ingest_batch(whole, 0, f"{tmp_path}/b")
    assert state(f"{tmp_path}/a") == state(f"{tmp_path}/b")
    assert any(k.startswith("equation:") for k in state(f"{tmp_path}/b"))
    seen = {r.doc_id: r.n_chunks for r in ingest.current_documents(spark, f"{tmp_path}/a").collect()}
    assert seen[21] == seen[22] == 0 and seen[30] > 0 and len(seen) == 13


def spread_pages(dice, rows_of):
    """One hot page and many small ones."""
    sizes = [260] + [dice.randrange(1, 9) for _ in range(40)]
    return [(1 + k // 7, k, i, *rows_of(k)) for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("pieces", [None, 5, 16, 60])
def test_folds_split_a_page(spark, pieces):
    dice = random.Random(pieces or 1)
    kinds = ["text", "text", "text", "table"]
    place = lambda: dice.randrange(0, 300) / 100

    def region(page):
        top = place()
        return (dice.choice(kinds), 0.1, None if dice.random() < 0.02 else top, 0.9, top + dice.choice([0.01, 0.02, 0.5]))

    rows = spread_pages(dice, region)
    df = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, region_type string, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for page in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == page), key=lambda r: (r[5] or 0.0, r[2]))
        merged = []
        for r in own:
            last = merged[-1] if merged else None
            if last and r[5] is not None and last["boxed"] and last["kind"] == r[3] and abs(r[5] - last["low"]) <= 0.02:
                last["ids"].append(f"{r[0]}:{r[2]}")
                last["low"] = max(last["low"], r[7])
            else:
                merged.append({"kind": r[3], "low": r[7], "boxed": r[5] is not None, "ids": [f"{r[0]}:{r[2]}"]})
        for k, m in enumerate(merged):
            want[(*page, k + 1)] = (m["kind"], m["low"], m["ids"])
    got = {(r.doc_id, r.page_number, r.region_ord): (r.region_type, r.y1, r.element_ids) for r in layout.merge_regions(df, pieces=pieces).collect()}
    assert got == want

    crops = [(d, p, i, float(dice.randrange(0, 700)), 0.0) for d, p, i, *_ in rows]
    crops = [(d, p, i, top, top + dice.choice([30.0, 60.0, 200.0])) for d, p, i, top, _ in crops]
    kept = set()
    for page in {c[:2] for c in crops}:
        held = []
        for c in sorted((c for c in crops if c[:2] == page), key=lambda c: c[2]):
            if not any(abs(a - c[3]) < 40 and abs(b - c[4]) < 40 for a, b in held):
                held.append(c[3:])
                kept.add(c[:3])
    df = spark.createDataFrame(crops, "doc_id long, page_number int, caption_pos long, y0 double, y1 double")
    assert {(r.doc_id, r.page_number, r.caption_pos) for r in layout.dedupe_crops(df, pieces=pieces).collect()} == kept

    words = [(d, p, i, f"w{i}" if dice.random() < 0.9 else " ", float(dice.randrange(0, 400)), float(dice.randrange(0, 500))) for d, p, i, *_ in rows]
    grid = {}
    for page in {w[:2] for w in words}:
        own = [w for w in words if w[:2] == page]
        row_of, total, n, row = {}, 0.0, 0, -1
        for y in sorted({w[5] for w in own}):
            k = sum(w[5] == y for w in own)
            if n and abs(y - total / n) <= 5:
                total, n = total + y * k, n + k
            else:
                total, n, row = y * k, k, row + 1
            row_of[y] = row
        anchors = []
        for x in sorted({w[4] for w in own}):
            if not anchors or x - anchors[-1] > 30:
                anchors.append(x)
        cells = {}
        for w in sorted(own, key=lambda w: (w[5], w[4], w[2])):
            col = min(range(len(anchors)), key=lambda c: (abs(anchors[c] - w[4]), c))
            cells.setdefault((row_of[w[5]], col), []).append(w[3])
        cells = {k: " ".join(v).strip() for k, v in cells.items() if " ".join(v).strip()}
        order = {r: i for i, r in enumerate(sorted({r for r, _ in cells}))}
        grid |= {(*page, order[r], c): (v, len(anchors)) for (r, c), v in cells.items()}
    df = spark.createDataFrame(words, "doc_id long, page_number int, word_num int, text string, x0 double, y0 double")
    found = recognition.words_to_grid(df, ["doc_id", "page_number"], pieces=pieces).collect()
    assert {(r.doc_id, r.page_number, r.row_idx, r.col_idx): (r.content, r.n_cols) for r in found} == grid


def test_crops_against_brute_force(spark):
    dice = random.Random(6)
    rules = [(1, p, x := float(dice.randrange(0, 300)), y := float(dice.randrange(-800, 1600)), x + dice.choice([50.0, 80.0, 200.0]), y + dice.choice([1.0, 5.0, 9.0])) for p in range(3) for _ in range(60 if p else 2)]
    captions = [(1, p, i, y := float(dice.randrange(-400, 1200)), y + 10, 612.0, 792.0) for p in range(4) for i in range(25)]
    want = {}
    for d, p, i, y0, y1, w, h in captions:
        near = [r for r in rules if r[1] == p and r[4] - r[2] >= 80 and r[5] - r[3] <= 5 and (abs(r[3] - y0) < 350 or abs(r[3] - y1) < 350)]
        top = min(r[3] for r in near) - 20 if near else max(0.0, y0 - 5)
        low = max(r[5] for r in near) + 15 if near else min(h, max(0.0, y0 - 5) + 240)
        left, right = (max(0.0, min(r[2] for r in near) - 10), min(w, max(r[4] for r in near) + 10)) if near else (0.0, w)
        want[p, i] = (left, max(0.0, min(y0 - 10, top)), right, min(h, max(low, y1 + 40)))
    c = spark.createDataFrame(captions, "doc_id long, page_number int, pos int, y0 double, y1 double, page_width double, page_height double")
    r = spark.createDataFrame(rules, "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    got = {(x.page_number, x.caption_pos): (x.x0, x.y0, x.x1, x.y1) for x in layout.crop_table_regions(c, r).collect()}
    assert got == want


def test_many_searches_against_brute_force(spark):
    dice = random.Random(13)
    word = lambda: "".join(dice.choice("abcÄé 1") for _ in range(dice.randrange(0, 12)))
    rows = [(f"n{i}", "text", word(), word() if i % 3 else None, None, "ab" if i == 5 else None, word()) for i in range(120)]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, label string, content string, raw_text string, caption string, context string")
    searches = [(i, word()[: i % 6]) for i in range(60)] + [(100, "AB"), (101, "ä"), (102, "zzz"), (103, ""), (104, "1\u0001a")]
    df = spark.createDataFrame(searches, "search_id long, text string")
    got = {(r.search_id, r.node_id) for r in graph.search_many(nodes, graph.gram_index(nodes), df).collect()}
    assert got == {(i, r[0]) for i, q in searches if q for r in rows if any(q.lower() in (t or "").lower() for t in r[2:])}
    assert graph.gram_index(nodes.limit(0)).count() == 0


def test_custom_embedder(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, content string")
    got = embedding.embed_chunks(chunks, embedder=lambda texts: [[0.1] * 4 for _ in texts]).collect()
    assert all(r.embedding == [0.1] * 4 for r in got)


def test_empty_query_is_zero(spark):
    q = spark.createDataFrame([(1, "")], "query_id long, query string")
    assert set(embedding.embed_queries(q).first().embedding) == {0.0}


def test_context_and_sources(spark):
    chunks = spark.createDataFrame([("a", 1, 3, "text", "Intro", "body", 0.0, 0.0, 1.0, 1.0)],
                                   "chunk_id string, doc_id long, page_number int, chunk_type string, section string, content string, x0 double, y0 double, x1 double, y1 double")
    hits = spark.createDataFrame([(7, "a", 0.5, 1)], "query_id long, id string, score double, rank int")
    assert search.format_context(hits, chunks).first().context == "[Source 1] Doc=1… | Page=3 | Type=text | Section=Intro\nbody"
    answers = spark.createDataFrame([(7, "As in [source 1].")], "query_id long, answer string")
    assert search.verify_sources(answers, hits, chunks).first().source_id == "Source 1"
    assert search.verify_sources(answers.withColumn("answer", F.lit("see [Source 2]")), hits, chunks).count() == 0
    assert search.verify_sources(answers.withColumn("answer", F.lit("no tag")), hits, chunks).count() == 1


def small_graph(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "y"), ("d", "a"), ("b", "d")]
    nodes = spark.createDataFrame([(n, "t") for n in "abcdxyz"], "node_id string, node_type string")
    return nodes, spark.createDataFrame([(s, t, "contains") for s, t in links], "src string, dst string, edge_type string"), links


def test_graph_traversal(spark):
    nodes, edges, links = small_graph(spark)
    pairs = spark.createDataFrame([("a", "c"), ("a", "y"), ("x", "y"), ("z", "z"), ("a", "nope")], "source string, target string")
    assert {(r.source, r.target): r.path for r in graph.shortest_paths(nodes, edges, pairs).collect()} == {
        ("a", "c"): ["a", "b", "c"], ("x", "y"): ["x", "y"], ("z", "z"): ["z"]}
    got = sorted(r.path for r in graph.all_simple_paths(edges, spark.createDataFrame([("a", "d")], "source string, target string"), 3).collect())
    assert got == [["a", "b", "c", "d"], ["a", "b", "d"], ["a", "d"]]
    assert {r.node_id: r.component for r in graph.connected_components(nodes, edges).collect()} == dict(a="a", b="a", c="a", d="a", x="x", y="x", z="z")
    members, inside = graph.k_hop(nodes, edges, spark.createDataFrame([("c",)], "node_id string"), 1)
    assert sorted(r.node_id for r in members.collect()) == ["b", "c", "d"] and inside.count() == 3
    assert graph.k_hop_nodes(nodes, edges, spark.createDataFrame([("q",)], "node_id string"), 2).count() == 0
    content = graph.section_content(edges, spark.createDataFrame([("b",)], "node_id string"))
    assert sorted(r.node_id for r in content.collect()) == ["a", "b", "c", "d"]  # the cycle ends


def test_shortest_paths_from_both_ends(spark, monkeypatch):
    dice = random.Random(23)
    chain = [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(60)]
    loose = {(f"n{dice.randrange(14)}", f"n{dice.randrange(14)}") for _ in range(30)}
    links = chain + sorted(loose)
    names = sorted({x for e in links for x in e})
    nodes = spark.createDataFrame([(x,) for x in names], "node_id string")
    edges = spark.createDataFrame(links + links[:5], "src string, dst string")
    asked = [("k000", "k060"), ("k000", "k059"), ("k003", "k001"), ("n1", "gone")] + [(f"n{a}", f"n{b}") for a in range(14) for b in range(14) if f"n{a}" in names and f"n{b}" in names]
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    got = {(r.source, r.target): (r.path, r.hops) for r in graph.shortest_paths(nodes, edges, spark.createDataFrame(asked, "source string, target string")).collect()}
    assert len(rounds) <= 1 + 2 * 31  # two tables a round, a round for two edges
    want = {}
    for a, b in asked:
        level = [[a]] if a in names else []
        seen = {a}
        while level and b not in {p[-1] for p in level}:
            best = {}
            for p in level:
                for x, y in links:
                    if x == p[-1] and y not in seen:
                        best[y] = min(best.get(y, [*p, y]), [*p, y])
            seen |= set(best)
            level = list(best.values())
        hit = [p for p in level if p[-1] == b]
        if hit and b in names:
            want[a, b] = (min(hit), len(min(hit)) - 1)
    assert got == want
    few = graph.shortest_paths(nodes, edges, spark.createDataFrame(asked, "source string, target string"), 3).collect()
    assert {(r.source, r.target): (r.path, r.hops) for r in few} == {k: v for k, v in want.items() if v[1] <= 3}


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    names = [f"n{i:04d}" for i in order]
    nodes = spark.createDataFrame([(x,) for x in names], "node_id string")
    edges = spark.createDataFrame(list(itertools.pairwise(names)), "src string, dst string")
    assert {r.component for r in graph.connected_components(nodes, edges).collect()} == {"n0000"}


def test_classifiers(spark):
    rows = spark.createDataFrame([("Summarize this",), ("a grown table",), ("what is doing",), ("hello",)], "q string")
    assert [r[0] for r in rows.select(classify.intent(F.col("q"))).collect()] == ["summary", "table", "citation", "qa"]
    assert rows.select(classify.clean_query(F.lit("tell me what is the loss in this paper"))).first()[0] == "loss"
    caps = spark.createDataFrame([("Table 1: x",), ("Table 2 shows x",), ("table 3 short",), ("Tables",)], "t string")
    assert [r[0] for r in caps.select(classify.is_table_caption(F.col("t"))).collect()] == [True, False, True, False]


def test_sentences_and_tokens(spark):
    row = spark.range(1).select(T.split_sentences(F.lit("One. Two! three? Four 5. 6 x")).alias("s"), T.estimate_tokens(F.lit("")).alias("z"), T.estimate_tokens(F.lit("ab")).alias("t")).first()
    assert row.s == ["One.", "Two! three?", "Four 5.", "6 x"] and (row.z, row.t) == (0, 1)


def test_grid(spark):
    words = [("a", 10.0, 100.0), ("b", 80.0, 101.0), ("c", 12.0, 120.0), ("d,e", 84.0, 121.0), ("f", 95.0, 121.0)]
    df = spark.createDataFrame([(1, i, t, x, y) for i, (t, x, y) in enumerate(words)], "region int, word_num int, text string, x0 double, y0 double")
    grid = recognition.words_to_grid(df, ["region"])
    cells = recognition.grid_to_cells(grid, ["region"])
    assert recognition.cells_to_csv(cells, ["region"]).first().csv_repr == 'a,b\r\nc,"d,e f"'


def test_index_maintenance(spark, tmp_path):
    index = vectors(spark)
    new = spark.createDataFrame([("a", 1, "moved", [0.0, 0.0, 0.0, 1.0]), ("n", 3, "text", [1.0, 0.0, 0.0, 0.0]), ("no", 3, "text", None)], index.schema)
    merged = ix.upsert_chunks(index, new)
    assert sorted((r.chunk_id, r.chunk_type) for r in merged.collect()) == [("a", "moved"), ("b", "table"), ("n", "text"), ("z", "text")]
    path = ix.persist_index(merged, str(tmp_path / "ix"), partitioned=True)
    kept = ix.delete_documents(ix.load_index(spark, path), spark.createDataFrame([(2,)], "doc_id long"))
    assert sorted(r.chunk_id for r in kept.collect()) == ["a", "n"]


def test_documents_skip_unreadable(spark, tmp_path):
    (tmp_path / "good.json").write_text('{\n "id": "d1", "metadata": {"title": "T", "page_count": 1},\n "elements": [{"id": "e", "content": "x"}], "chunks": []\n}')
    (tmp_path / "bad.json").write_text("{ not json")
    docs = D.read_processed_docs(spark, str(tmp_path))
    assert [r.id for r in docs.collect()] == ["d1"]
    assert D.explode_children(docs, "elements").first().content == "x"


def test_rewriting_one_document_keeps_the_others(spark, tmp_path):
    from quire import schemas
    from quire.sources import documents as D

    docs = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("status"))
    shape = spark.createDataFrame([], schemas.DOCUMENT)
    docs = shape.unionByName(docs, allowMissingColumns=True)
    path = str(tmp_path / "docs")
    D.write_processed_docs(docs, path)
    D.write_processed_docs(docs.where("id = '7'").withColumn("status", F.lit("new")), path)
    D.delete_processed_docs(spark, path, spark.createDataFrame([("9",), ("none",)], "id string"))
    got = {r.id: r.status for r in D.read_processed_docs(spark, path, multi_line=False).collect()}
    assert got == {str(i): "new" if i == 7 else "old" for i in range(50) if i != 9}
    D.delete_processed_docs(spark, path, docs.select("id"))
    assert D.read_processed_docs(spark, path, multi_line=False).count() == 0


def test_upsert_takes_the_last_row_of_an_id(spark):
    from quire.sources import index as ix

    old = spark.createDataFrame([("a", 1, [1.0], 0)], "chunk_id string, doc_id long, embedding array<double>, seen int")
    new = spark.createDataFrame([("a", 1, [2.0], 1), ("a", 1, [3.0], 2), ("b", 1, None, 3)], old.schema)
    assert [tuple(r) for r in ix.upsert_chunks(old, new, order_col="seen").collect()] == [("a", 1, [3.0], 2)]


def test_wide_and_reversed_ranges_link_existing_entries(spark):
    from quire.operators import citations

    cites = spark.createDataFrame([(1, "c1", "numeric", "[1-3000000000]"), (1, "c2", "numeric", "[3-2]"), (1, "c3", "numeric", "[9]")], "doc_id long, citation_id string, kind string, cite_key string")
    refs = spark.createDataFrame([(1, f"r{i}", i, i, ["A. Name"]) for i in (1, 2, 3)], "doc_id long, reference_id string, ref_index long, pos int, authors array<string>")
    rows = {(r.citation_id, r.ref_index, r.reference_id) for r in citations.link_citations(cites, refs, expand=True).collect()}
    assert rows == {("c1", 1, "r1"), ("c1", 2, "r2"), ("c1", 3, "r3"), ("c2", 2, "r2"), ("c2", 3, "r3"), ("c3", 9, None)}


def test_section_content_follows_deep_chains(spark):
    from quire.operators import graph

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "contains") for i in range(40)] + [("n40", "n0", "contains")], "src string, dst string, edge_type string")
    out = graph.section_content(edges, spark.createDataFrame([("n0",)], "node_id string"))
    assert out.count() == 41 and out.agg(F.max("depth")).first()[0] == 41


def test_search_ranks_on_the_full_score(spark):
    from quire.operators import search

    index = spark.createDataFrame([("a", [1.0, 0.0003]), ("b", [1.0, 0.0]), ("c", [None, 1.0]), ("d", [1.0])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.id for r in search.knn_topk(asked, index, 1).collect()] == ["b"]
    typed = index.withColumn("chunk_type", F.when(F.col("chunk_id") == "a", "x").otherwise("y"))
    assert [r.id for r in search.knn_topk(asked.withColumn("first_type", F.lit("x")), typed, 5).collect()] == ["a"]
