"""Registered queries of the document operators against their SQL at the smallest size; tests/check.py runs all of them."""

from __future__ import annotations

import pytest

from quire.plans.all_queries import CHECKS, QUERIES
from tests.check import compare, duck

ROOT = "/root/testdata/sf0.001"
QUICK = """
    text_to_elements html_to_elements estimate_tokens split_sentences assign_sections pack_chunks tree_parent tree_depth read_processed_docs write_processed_docs
    rewrite_processed_docs explode_children persist_index upsert_chunks delete_document delete_stored chatml_dataset extract_citations reference_year parse_authors
    link_citations link_citations_expanded extract_equations dedupe_equations math_score equation_variables clean_to_latex is_equation_like classify_region merge_regions
    pair_figure_captions figure_type table_caption_filter page_elements figure_filter normalize_bbox classify_ocr_line route_pipeline parse_metadata knn_topk knn_by_type
    knn_postfilter knn_in_scope doc_ids_filter hash_ngrams classify_intent clean_query reading_order_edges list_documents user_documents chat_history
    ocr_words_to_lines ocr_page_confidence ocr_line_filter_and_word_boxes words_to_grid grid_to_cells cells_to_csv crop_table_region dedupe_crops pair_table_captions
    tfidf embed_query embed_chunks special_chunks union_entities order_chunks search_fallback upsert_chunks_append stream_ingest stream_citations
    build_nodes nodes_by_type search_nodes_many shortest_path processing_stats document_summary corpus_analytics review_features
""".split()


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, con, name):
    diff, _ = compare(spark, con, ROOT, QUERIES[name], CHECKS.get(name))
    assert not diff, diff
