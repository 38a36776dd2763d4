"""Physical plans: what is pushed down, kept in the JVM, and cut before shuffles."""

import re

import pytest

from foliospark.operators.index import StoredIndex
from foliospark.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Parsers, stemmers, models and archives need Python; so do batched vector products.
PYTHON = {
    "semantic_edges", "dense_topk", "porter_bm25", "stemmed_hybrid", "stored_index_topk", "stored_index_stats", "rerank_topk", "embedded_sections", "layered_answers", "model_judge", "quantize_float16", "html_sections", "wordpiece_encode",
    "archive_roundtrip", "archive_vectors", "archive_info", "delimited_sections", "html_tables", "html_title", "docx_sections", "xlsx_tables", "parser_registry",
}
NATIVE = sorted(set(catalog.QUERIES) - PYTHON)


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text), text


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_document", "dense_topk", "hybrid_topk", "key_numbers_top"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, DATA))


def test_scans_read_the_columns_they_need(spark):
    for name, columns in (("section_tree", {"doc_id", "text"}), ("keywords_topk", {"doc_id", "text"}), ("doc_slug", {"p_partkey", "p_name", "p_brand", "p_size"}), ("html_title", {"page_id", "html"}), ("phase_rollup", {"doc_id", "lang", "source", "quality", "toxic"})):
        text = plan(catalog.QUERIES[name](spark, DATA))
        read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",")}
        assert read == columns, (name, read)


def scans(text):
    return len(re.findall(r"\n[^\n]*FileScan parquet", "\n" + text))


def test_tables_are_scanned_few_times(spark):
    """BM25 reads the documents once for hits, once for their number and once for lengths; in-row BM25 reads sections and questions; the rest are edges."""
    assert scans(plan(catalog.QUERIES["bm25_topk"](spark, DATA))) <= 3
    assert scans(plan(catalog.QUERIES["hybrid_topk"](spark, DATA))) <= 7


def test_terms_are_pushed_to_stored_postings(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "§1", "", "one two"), ("b", 0, "§1", "", "three")], "doc_id string, sec_idx int, id string, title string, text string")
    stored = StoredIndex(spark, f"file://{tmp_path}/index")
    stored.add(rows)
    text = plan(stored.tokens(spark.createDataFrame([("one",), ("two",)], "term string")))
    assert "PushedFilters: [In(term, [one,two])]" in text or "In(term" in text


def test_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["query_confidence"](spark, DATA))
    assert "EqualTo(role,user)" in text


def test_a_tree_is_shuffled_once(spark):
    assert plan(catalog.QUERIES["section_tree"](spark, DATA)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["key_number_match", "layer_route", "layered_answers"])
def test_answers_send_no_table_through_the_driver(spark, name):
    """Questions, documents and hits grow together, and their files' sizes say little of their texts: no join broadcasts them."""
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, DATA))
