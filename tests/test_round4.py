"""Steps that are done once, and results that stay the same."""

import numpy as np
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import mathematics as M
from quire.functions import ngrams
from quire.operators import chunking, layout, recognition, search


def test_packing_reads_its_elements_once(spark, tmp_path):
    """Chunks come from stored blocks, oversized elements too; the elements are not read and sorted for each branch again."""
    long = " ".join(f"Sentence number {i} is here." for i in range(200))
    rows = [(1, 0, 1, 0, "heading", "One"), (1, 1, 1, 1, "paragraph", "short text"), (1, 2, 1, 2, "paragraph", long), (1, 3, 1, 3, "paragraph", "tail")]
    path = str(tmp_path / "elements")
    spark.createDataFrame(rows, "doc_id long, pos int, page_number int, reading_order int, element_type string, content string").write.parquet(path)
    chunks = chunking.pack_chunks(spark.read.parquet(path))
    assert not any(path in f for f in chunks.inputFiles())
    got = {(r.first_pos, r.part): r.content for r in chunks.collect()}
    assert got[1, 0] == "short text" and got[3, 0] == "tail"
    parts = [got[k] for k in sorted(got) if k[0] == 2]
    assert len(parts) > 1 and "\n\n".join(parts).replace("\n\n", " ") == long


def test_plan_reads_the_index_once_if_every_question_has_hits(spark, monkeypatch):
    """The second search is for typed questions without hits only; a null component keeps a vector out."""
    calls = []
    knn = search.knn_topk
    monkeypatch.setattr(search, "knn_topk", lambda *a, **b: calls.append(a) or knn(*a, **b))
    size = search.embed_queries(spark.createDataFrame([(0, "x y")], "query_id long, query string")).first().embedding
    ones, hole = [1.0] * len(size), [None] + [1.0] * (len(size) - 1)
    index = spark.createDataFrame([("a", "text", ones), ("b", "table", ones), ("c", "text", hole), ("d", "text", [0.0] * len(size))], "chunk_id string, chunk_type string, embedding array<double>")
    asked = spark.createDataFrame([(1, "what is shown here"), (2, "which table shows it")], "query_id long, query string")
    got = sorted((h.query_id, h.id) for h in search.retrieval_plan(asked, index).collect())
    assert got == [(1, "a"), (1, "b"), (1, "d"), (2, "b")] and len(calls) == 1
    calls.clear()
    got = sorted((h.query_id, h.id) for h in search.retrieval_plan(asked, index.where("chunk_type = 'text'")).collect())
    assert got == [(1, "a"), (1, "d"), (2, "a"), (2, "d")] and len(calls) == 2


def test_every_mathematical_character_passes_the_first_look(spark):
    marks = [*fixed.MATH_OPERATOR[1:-1], *fixed.GREEK_LETTER[1:-1], "\\", "(", "_", "^"]
    rows = spark.createDataFrame([(c,) for c in marks], "c string")
    assert rows.where(~F.col("c").rlike(M._MATH_CHARACTER)).count() == 0
    assert not spark.createDataFrame([("plain prose, 1 to 3: über alles.",)], "c string").where(F.col("c").rlike(M._MATH_CHARACTER)).count()


def test_sparse_cells_are_counted_like_dense_ones():
    for n in (10, 10_000):
        found, count = ngrams._counted(np.array([3, 7, 3, 9]), n)
        assert found.tolist() == [3, 7, 9] and count.tolist() == [2, 1, 1]


def test_lines_are_dealt_out_by_run_and_words_within_them(spark):
    """Words of a line far apart in the input come together in order; no word is a row of a shuffle."""
    rows = []
    for i in range(300):
        for k in range(7):
            rows.append((1, 1, 1, 1, i % 60, 10 * (i // 60) + k, f" w{i}ü {k} ", float(k * 9 % 7), 5.0, 4.0, 2.0, 80.0 + k if k else -1.0))
    names = "doc_id long, page_number int, block_num int, par_num int, line_num int, word_num int, text string, left double, top double, width double, height double, conf double"
    words = spark.createDataFrame(rows, names).repartition(3)
    lines = recognition.words_to_lines(words, 1.0, 1.0)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    got = {r.line_num: r for r in lines.collect()}
    for line in range(60):
        own = sorted((max(0.0, r[7]), r[5], r[6].strip(), r[11]) for r in rows if r[4] == line and r[11] >= 0)
        assert got[line].text == " ".join(w[2] for w in own) and got[line].n_words == len(own) and got[line].conf_sum == sum(w[3] for w in own)
    boxes = recognition.line_words(lines)
    assert "Window" not in boxes._jdf.queryExecution().executedPlan().toString()
    one = sorted((r for r in boxes.collect() if r.line_num == 5), key=lambda r: r.word_num)
    assert [r.text for r in one] == got[5].text.split()
    per = (got[5].x1 - got[5].x0) / len(got[5].text)
    assert all(abs(r.wx0 - got[5].x0 - per * len(" ".join(x.text for x in one[: i]) + " " * (i > 0))) < 1e-9 for i, r in enumerate(one))


def test_crops_read_captions_and_regions_once(spark, tmp_path):
    """Captions are stored before they are asked for, regions before they are folded."""
    names = "doc_id long, page_number int, pos int, y0 double, y1 double, page_width double, page_height double"
    spark.createDataFrame([(1, 1, 4, 300.0, 310.0, 612.0, 792.0), (1, 1, 9, 305.0, 316.0, 612.0, 792.0)], names).write.parquet(str(tmp_path / "captions"))
    rules = spark.createDataFrame([(1, 1, 50.0, 320.0, 400.0, 321.0)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    crops = layout.crop_table_regions(spark.read.parquet(str(tmp_path / "captions")), rules)
    assert not any(str(tmp_path) in f for f in crops.inputFiles())
    assert {r.caption_pos: (r.x0, r.y0, r.x1, r.y1) for r in crops.collect()} == {4: (40.0, 290.0, 410.0, 350.0), 9: (40.0, 295.0, 410.0, 356.0)}
    crops.write.parquet(str(tmp_path / "crops"))
    kept = layout.dedupe_crops(spark.read.parquet(str(tmp_path / "crops")))
    assert not any(str(tmp_path) in f for f in kept.inputFiles()) and [r.caption_pos for r in kept.collect()] == [4]
