"""Faults that the reviewer of round 3 found, each as a small case."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest

from quire.functions import ngrams
from quire.operators import graph, recognition, search
from quire.plans import graphs
from quire.plans.all_queries import CHECKS, QUERIES
from tests.check import compare, duck

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_entity_preview_matches_its_sql(spark, con):
    diff, _ = compare(spark, con, ROOT, QUERIES["entity_preview"], CHECKS["entity_preview"])
    assert not diff, diff


def _linked(rows):
    """Smallest node of every node's component, by repeated merging."""
    least = {n: n for r in rows for n in r[:2]}
    moved = True
    while moved:
        moved = False
        for a, b in (r[:2] for r in rows):
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("run", [3, 1 << 18])
@pytest.mark.parametrize("named", [True, False])
def test_components_of_runs_that_share_nodes(spark, run, named):
    """Documents as chains, joined by shared nodes, cut into runs of few edges; a node without edges and ends that are no nodes."""
    rows = [(f"d{d}:{i:03}", f"d{d}:{i + 1:03}", d) for d in range(6) for i in range(20)]
    rows += [("hub", f"d{d}:007", d) for d in (0, 2, 4)] + [("hub2", "d4:003", 4), ("d5:001", "hub2", 5), ("d3:004", "d3:004", 3)]
    want = _linked(rows) | {"alone": "alone"}
    nodes = spark.createDataFrame([(n,) for n in want if n != "d1:010"] + [("hub",)], "node_id string")
    edges = spark.createDataFrame(rows, "src string, dst string, doc_id long")
    got = graph.connected_components(nodes, edges if named else edges.drop("doc_id"), run).collect()
    del want["d1:010"]
    assert len(got) == len(want) and {r.node_id: r.component for r in got} == want


def test_components_contract_documents_before_any_shuffle_of_links(spark, monkeypatch):
    """What reaches the rounds of joins is links between runs, not the edges."""
    sizes = []
    cut = graph.cut_lineage

    def counted(df):
        kept = cut(df)
        if df.columns == ["u", "v"]:
            sizes.append(kept.count())
        return kept

    monkeypatch.setattr(graph, "cut_lineage", counted)
    rows = [(f"{d}:{i:04}", f"{d}:{i + 1:04}", d) for d in range(10) for i in range(200)] + [("z", f"{d}:0100", d) for d in range(10)]
    edges = spark.createDataFrame(rows, "src string, dst string, doc_id long")
    got = graph.connected_components(edges.select(graph.F.col("src").alias("node_id")), edges).collect()
    assert {r.component for r in got} == {"0:0000"} and max(sizes) < 100


def test_entities_come_from_stored_elements(spark, monkeypatch):
    """Texts are cut into elements once for a whole graph."""
    calls = []
    cut = graphs.derived.elements
    monkeypatch.setattr(graphs.derived, "elements", lambda *a: calls.append(a) or cut(*a))
    parts = graphs._parts(spark, ROOT)
    assert len(calls) == 1 and sorted(parts) == ["citations", "elements", "equations", "figures", "metadata", "references", "tables"]
    assert sorted(graphs._parts(spark, ROOT, "metadata", "citations")) == ["citations", "metadata"]


@pytest.mark.parametrize("whole", [1, 40, 1 << 16])
def test_grids_of_small_pages_are_those_of_folds(spark, whole):
    """Pages below the limit are laid out in one task each, above it by folds: the same cells."""
    dice = random.Random(3)
    words = [(p, k, dice.choice(["a", "b,c", " d ", "  ", "é"]), float(dice.randrange(0, 400)), dice.randrange(0, 60) / dice.choice([1, 2])) for p in range(5) for k in range(60 if p else 12)]
    words += [(7, 1, "\t", 3.0, 4.0), (8, 1, None, 3.0, 4.0), (8, 2, "x", 90.0, 4.0), (None, 1, "lost", 1.0, 1.0), (8, 3, "lost", None, 1.0), (8, 4, "lost", 1.0, None)]
    df = spark.createDataFrame(words, "page_number int, word_num int, text string, x0 double, y0 double")
    want = recognition.words_to_grid(df, ["page_number"], pieces=3)
    got = recognition.words_to_grid(df, ["page_number"], whole=whole)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    full = sorted((r.page_number, r.row_idx, r.col_idx, r.content) for r in recognition.grid_to_cells(got, ["page_number"]).collect())
    cells = {(r.page_number, r.row_idx, r.col_idx): r.content for r in want.collect()}
    size = {(r.page_number, r.row_idx): r.n_cols for r in want.collect()}
    assert full == sorted((*k, c, cells.get((*k, c), "")) for k, n in size.items() for c in range(n))


def test_small_pages_shuffle_words_once(spark):
    words = spark.createDataFrame([(1, 1, "a", 1.0, 2.0)], "page_number int, word_num int, text string, x0 double, y0 double")
    plan = recognition.words_to_grid(words, ["page_number"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_searches_meet_cells_without_an_index(spark):
    """Every search finds what search_nodes() finds, whatever the cells and blocks; equal searches each, empty ones nothing."""
    texts = ["Abc déf", "abcabc", "", None, "x\x00y", "ÉTÉ abX", "zz bcd"]
    nodes = spark.createDataFrame([(f"n{i}", a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1]))], "node_id string, label string, content string")
    searches = [(1, "bc"), (2, "BCAB"), (3, ""), (4, None), (5, "é"), (6, "c d"), (7, "bc"), (8, "fabc"), (9, "x\x00y"), (10, "no such words"), (11, "abcd")]
    asked = spark.createDataFrame(searches, "search_id long, text string")
    fields = ["label", "content"]
    want = sorted((i, r.node_id) for i, q in searches if q for r in graph.search_nodes(nodes, q, fields=fields).collect())
    for cell, block in [(2, 3), (4096, 512)]:
        got = graph.search_each(nodes, asked, fields, ["node_id"], cell, block)
        assert got.columns == ["search_id", "node_id"] and sorted(map(tuple, got.collect())) == want


def test_pairs_are_hashed_as_terms_of_their_own():
    """Words in one bucket still give pairs of different buckets, and no pair crosses two texts."""
    code = lambda term: int.from_bytes(hashlib.md5(term.encode()).digest()[:4], "big") % 8
    texts = ["ab cd ef ab cd", "", "gh", "ef ab"]
    n, buckets, counts = ngrams.count_ngrams(texts, 8, whole=True)
    at = 0
    for text, size in zip(texts, n.tolist()):
        words = text.split()
        want = Counter(map(code, words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
        assert dict(zip(buckets[at : at + size].tolist(), counts[at : at + size].tolist())) == want
        at += size


def test_oversampled_scope_scans_the_index_once(spark, monkeypatch):
    """Questions with and without documents of their own are answered together, each with its own number of hits."""
    calls = []
    knn = search.knn_topk
    monkeypatch.setattr(search, "knn_topk", lambda *a, **b: calls.append(a) or knn(*a, **b))
    dice = random.Random(9)
    index = [(f"c{i:02}", i % 4, [dice.random(), dice.random()]) for i in range(40)]
    asked = [(q, [dice.random(), dice.random()]) for q in range(6)]
    scope = [(q, q % 4) for q in range(4)]
    got = search.knn_in_scope(
        spark.createDataFrame(asked, "query_id long, embedding array<double>"), spark.createDataFrame(index, "chunk_id string, doc_id long, embedding array<double>"),
        spark.createDataFrame(scope, "query_id long, doc_id long"), 2, "oversample",
    ).collect()
    want = []
    for q, v in asked:
        near = sorted(index, key=lambda r: (-round(sum(a * b for a, b in zip(v, r[2])) / math.hypot(*v) / math.hypot(*r[2]), 12), r[0]))
        mine = [r for r in near[:10] if r[1] == q % 4] if q < 4 else near
        want += [(q, r[0], k + 1) for k, r in enumerate(mine[:2])]
    assert sorted((r.query_id, r.id, r["rank"]) for r in got) == sorted(want) and len(calls) == 1
