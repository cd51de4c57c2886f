"""Counts of a document's children come from marks of its elements, not from their texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from quire.operators import catalog, chunking, citations, equations, recognition

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["processing_stats", "document_summary", "corpus_analytics"])
def test_counting_queries_store_no_texts_and_read_words_once(spark, name):
    df = queries()[name](spark, ROOT)
    made = {f.rsplit("/", 1)[0] for f in df.inputFiles() if ROOT not in f}
    assert made
    for path in made:
        fields = spark.read.parquet(path).schema.simpleString()
        assert "content:" not in fields and "text:" not in fields, fields
    assert df._jdf.queryExecution().optimizedPlan().toString().count("posexplode(split(content") <= 1


def _elements(spark):
    """Three documents over many blocks: headers, blank, oversized and repeated elements, with and without bibliographies."""
    dice = random.Random(11)
    types = ["paragraph"] * 8 + ["heading", "caption", "equation", "table", "abstract", None]
    texts = [
        "", "  ", "x", "Word " * 30, "A sentence of words. " * 60, "Long one. " * 400, "word" * 700, "see [1, 3] and Okafor et al. (2015) (Lindqvist, 2019)",
        "f(x) = α_{i} + x^2 (3)", "costs $a + b$ and $a + b$", "$$y=x$$", "g(a) x_i (1)", "a_1 = b (2)", " Bibliography ", "Works Cited", "ten chars!", " nine chars",
    ]
    rows = []
    for doc in range(6):
        for pos in range(70):
            kind, text = dice.choice(types), dice.choice(texts)
            if doc % 3 == 0 and pos in (40, 61):
                kind, text = "references", "References [2]"
            if doc % 3 == 1 and text.strip() in ("Bibliography", "Works Cited"):
                text = "other words"
            if doc < 3 and pos > 45 and kind in ("heading", "abstract"):
                kind = "paragraph"
            rows.append((doc, pos, pos // 8 + 1, pos % 8, kind, None if dice.random() < 0.03 else text))
    rows.append((7, 900, 1, 0, "paragraph", "alone"))
    return spark.createDataFrame(rows, "doc_id long, pos int, page_number int, reading_order int, element_type string, content string").repartition(5)


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_counts_equal_the_rows_of_the_operators(spark, block):
    elements = _elements(spark)
    marks = catalog.element_marks(elements)
    blocks = catalog.element_blocks(marks, block)

    def numbers(df):
        got = Counter()
        for r in df.collect():
            got[r.doc_id] += r.n
        return +got

    def rows(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    chunks, refs, cites = rows(chunking.pack_chunks(elements)), rows(citations.extract_references(elements)), rows(citations.extract_citations(elements))
    assert len(chunks) == 7 and len(refs) >= 3 and sum(cites.values()) > 30
    assert numbers(chunking.count_chunks(blocks)) == chunks
    assert numbers(citations.count_references(blocks)) == refs
    assert numbers(blocks.select("doc_id", F.col("citations").alias("n"))) == cites
    assert numbers(blocks.select("doc_id", F.col("elements").alias("n"))) == rows(elements)
    assert rows(catalog.count_equations(marks)) == rows(equations.extract_equations(elements))


def test_blank_words_and_words_without_confidence_leave_a_page_certain(spark):
    names = "doc_id long, page_number int, text string, conf double"
    words = spark.createDataFrame([(1, 1, "a", 50.0), (1, 1, " ", 10.0), (1, 1, "ü", 90.0), (1, 1, "~~", 40.0), (1, 2, " ", 70.0), (1, 2, "b", -1.0), (2, 1, None, 5.0)], names)
    got = {(r.doc_id, r.page_number): (round(r.mean_confidence, 9), r.n_words) for r in recognition.page_confidence(words).collect()}
    assert got == {(1, 1): (0.6, 3), (1, 2): (1.0, 0), (2, 1): (1.0, 0)}
