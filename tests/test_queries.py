"""Registered queries against their SQL on the smallest tables.

A selection keeps the suite short; ``python -m tests.oracle <folder>`` compares every query.
"""

import pytest

import __spark_entry__ as entry_point
from cartulary.operators import evidence as E
from cartulary.plans import load_queries
from tests.oracle import compare, connect, spark_bag, sql_bag

FOLDER = "/root/testdata/sf0.001"
SELECTED = (
    "chunk_sources",
    "hash_embedding_md5",
    "cosine_topk_scoped",
    "retrieve_boosted",
    "section_keywords",
    "best_sentence",
    "outline_parent",
    "outline_subtree",
    "tree_order",
    "nested_tree",
    "edge_evidence",
    "contents_pages",
    "clean_lines",
    "bookmark_sections",
    "fold_misstyled",
    "paragraph_sections",
    "node_context",
    "validate_citations",
    "answer_view",
    "apply_enrichment",
    "upload_validation",
    "stored_chunks",
    "reap_stale",
    "stream_status",
    "stream_expired",
)


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SELECTED)
def test_query_equals_its_sql(spark, connection, name):
    item = load_queries()[name]
    assert compare(spark_bag(item.run(spark, FOLDER)), sql_bag(connection, item.sql)) is None


def test_entry_point(spark):
    registered = entry_point.queries()
    assert set(entry_point.oracle_sql()) <= set(registered) and len(registered) > 80
    assert entry_point.entry(spark).columns[0] == "question_id"


def test_headings_with_long_numbers_are_one_title(spark, tmp_path):
    rows = [(n, "x" * size, "en", "src", size) for n, size in ((2, 3), (12340, 9), (49680, 5), (49681, 4))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = load_queries()["dedupe_headings"].run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [("src", 2, "en 12340", 9), ("src", 49681, "en 49681", 4)]


def test_edge_evidence_lists_all_links_of_a_child(spark):
    edges = spark.createDataFrame([("e", "d", "p", "c")], "edge_id string, document_id string, parent_node_id string, child_node_id string")
    rows = [("d", "k%02d" % n, E.TARGET_NODE, "c", n % 2, n // 2 + 1, n) for n in range(13)]
    links = spark.createDataFrame(rows, "document_id string, chunk_id string, target_type string, target_id string, source_section_index int, rank int, chunk_index int")
    for whole, size in ((False, 12), (True, 13)):
        found = E.link_edges(edges, links, whole=whole).orderBy("rank").collect()
        assert [(r["chunk_id"], r["rank"]) for r in found] == [("k%02d" % n, n + 1) for n in range(size)]
