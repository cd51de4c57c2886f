"""Empty texts in streams; what large jobs leave on the disk."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.plans.all_queries import CHECKS, QUERIES
from quire.operators import embedding, graph, layout, recognition, search, sections
from quire.sources import index
from tests.check import compare


@pytest.mark.parametrize("name", ["stream_citations", "stream_ingest"])
def test_documents_with_empty_texts_stay_apart_from_those_sent_again_without_content(spark, tmp_path, name):
    """An empty text still has a bibliography in the SQL; null texts and documents taken back have nothing."""
    texts = ["A title\nFirst line of words\nmore words here", "", None, "One line", " ", "Zeta\n\nx_i = y (1)\nnine\nten"]
    rows = [(i, texts[i % 6], "en", "web", len(texts[i % 6] or "")) for i in range(60)]
    root = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{root}/documents.parquet/*.parquet')")
    diff, n = compare(spark, con, root, QUERIES[name], CHECKS[name])
    assert not diff and n, diff


def test_changes_leave_no_copies_and_write_compressed_texts(spark, tmp_path, monkeypatch):
    """Rows of a changed bucket lie on the disk once, packed; rows with other and with null keys stay, new ones come in."""
    monkeypatch.setattr(index, "BUCKET_ROWS", 10)
    monkeypatch.setattr(index, "scratch_path", lambda spark, name: f"{tmp_path}/scratch/{name}-{len(os.listdir(tmp_path))}")
    path = f"{tmp_path}/docs"
    rows = spark.range(40).selectExpr("case when id = 39 then null else cast(id as string) end as id", "'old' as status", "repeat('a text. ', 500) as filename")
    index.create_bucketed(rows, path, "json", "id", "id_bucket")
    again = spark.sql("select * from values ('3', 'new'), ('4', 'new'), ('77', 'new'), (null, 'new') as t(id, status)")
    schema = "id string, status string, filename string, id_bucket int"
    index.change_bucketed(spark, path, "json", "id", "id_bucket", spark.read.schema(schema).json(path), again, again)
    index.change_bucketed(spark, path, "json", "id", "id_bucket", spark.read.schema(schema).json(path), rows.where("id in ('5', '3')"))
    got = sorted((r.id or "", r.status, len(r.filename or "")) for r in spark.read.schema(schema).json(path).collect())
    kept = [(str(i), "old", 4000) for i in range(39) if i not in (3, 4, 5)]
    assert got == sorted([*kept, ("", "old", 4000), ("", "new", 0), ("4", "new", 0), ("77", "new", 0)])
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert not os.listdir(tmp_path / "scratch")


@pytest.mark.parametrize("whole", [1, 40, 1 << 16])
def test_csv_texts_are_written_where_pages_are_laid_out(spark, whole):
    """The texts of small pages need no rows of cells and are those that cells give; a page's words may lie far apart."""
    dice = random.Random(5)
    words = [(p, k, dice.choice(["a", "b,c", ' "d" ', "  ", "é", "f\r\ng"]), float(dice.randrange(0, 400)), dice.randrange(0, 60) / 2) for k in range(60) for p in range(5) if p or k < 12]
    words += [(7, 1, "\t", 3.0, 4.0), (8, 1, None, 3.0, 4.0), (8, 2, "x", 90.0, 4.0), (None, 1, "lost", 1.0, 1.0), (8, 3, "lost", None, 1.0), (9, 1, "l", 0.0, 0.0), (9, 2, "r", 99.0, 50.0)]
    df = spark.createDataFrame(words, "page_number int, word_num int, text string, x0 double, y0 double")
    cells = recognition.grid_to_cells(recognition.words_to_grid(df, ["page_number"], pieces=3), ["page_number"])
    want = sorted(map(tuple, recognition.cells_to_csv(cells, ["page_number"]).collect()))
    got = recognition.words_to_csv(df, ["page_number"], whole=whole)
    assert sorted(map(tuple, got.collect())) == want and dict(want)[9] == "l,\r\n,r"
    if whole > 60:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("mode", ["oversample", "exact"])
def test_fallback_deals_the_index_out_once(spark, monkeypatch, mode):
    """Cleaned and general forms are asked with the questions; counts give the hits that vectors give."""
    calls = []
    knn = search.knn_topk
    monkeypatch.setattr(search, "knn_topk", lambda *a, **b: calls.append(a) or knn(*a, **b))
    texts = ["alpha beta", "beta gamma delta", "overview of the paper and its main contributions", "", "alpha alpha", None, "zeta eta"]
    rows = [(f"c{i}", i % 3, t, "text") for i, t in enumerate(texts * 4)]
    counted = embedding.with_counts(spark.createDataFrame(rows, "chunk_id string, doc_id long, content string, chunk_type string"), "content").localCheckpoint()
    idf = embedding.inverse_frequencies(embedding.bucket_frequencies(counted))
    dense = embedding.tfidf_vectors(counted, "content")
    asked = spark.createDataFrame([(-1, "what is the alpha"), (2, "beta"), (9, "beta"), (3, "no such words"), (1 << 62, "eta zeta?")], "query_id long, query string")
    scope = spark.createDataFrame([(-1, 0), (2, 1), (2, 1), (3, 77), (1 << 62, 2)], "query_id long, doc_id long")
    want = sorted(map(tuple, search.search_fallback(asked, dense, 2, scope, mode).collect()))
    got = search.search_fallback(asked, counted, 2, scope, mode, idf)
    assert len(calls) == (2 if mode == "oversample" else 4)  # with and without a scope in exact mode
    got = sorted(map(tuple, got.collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))
    assert {r[0] for r in got} >= {-1, 2, 9} and 3 not in {r[0] for r in got}


def test_sections_and_blocks_take_one_shuffle(spark):
    """Rows placed in their section are grouped by section and block where they lie."""
    rows = spark.range(10).selectExpr("id % 2 as doc_id", "cast(id as int) as pos", "'paragraph' as element_type", "'text' as content", "id div 4 as blk")
    placed = sections.assign_sections(rows, block="blk")
    plan = placed.groupBy("doc_id", "section_pos", "blk").agg(F.collect_list("content"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "section_pos" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_captions_stand_for_their_elements(spark):
    names = "doc_id long, page_number int, pos int, element_type string, content string, y0 double, y1 double"
    texts = [("caption", "any words"), ("paragraph", "Fig 3 shows"), ("paragraph", "Table 2 lists"), ("paragraph", "plain words"), ("paragraph", None)]
    elements = spark.createDataFrame([(1, 1, i, kind, text, i / 5, i / 5 + 0.1) for i, (kind, text) in enumerate(texts)], names)
    kept = layout.caption_candidates(elements)
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 2]


def test_simple_paths_follow_the_edges_of_the_backward_sweep(spark):
    """Random graph with cycles, loops and repeated edges, several targets of a source and sources of a target."""
    dice = random.Random(2)
    links = [(f"n{dice.randrange(12)}", f"n{dice.randrange(12)}") for _ in range(30)] + [(f"n{i}", "dead end") for i in range(12)]
    asked = [("n0", "n1"), ("n0", "n2"), ("n3", "n1"), ("n4", "n4"), ("n5", "n6"), ("n5", "n6"), ("away", "n1")]
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    for most in (1, 2, 4):
        want, open_ = [], [(b, [a]) for a, b in {p for p in asked if p[0] != p[1]}]
        while open_:
            target, path = open_.pop()
            if path[-1] == target:
                want.append(path)
            elif len(path) <= most:
                open_ += [(target, [*path, x]) for x in out.get(path[-1], ()) if x not in path]
        got = graph.all_simple_paths(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(asked, "source string, target string"), most)
        assert sorted(r.path for r in got.collect()) == sorted(want)


def test_paths_need_no_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "build_nodes", lambda **parts: pytest.fail("nodes are built"))
    assert QUERIES["all_simple_paths"](spark, "/root/testdata/sf0.001").columns == ["source", "target", "path"]
