"""Scores at the edges of the SQL: questions whose tokens cancel, and ninth digits halfway between two sixth ones."""

import math
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cartulary.operators.retrieval import retrieve
from cartulary.plans import load_queries
from tests.oracle import TABLES, compare, connect, spark_bag, sql_bag

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["retrieve_documents", "retrieve_boosted"])
def test_cancelled_questions_follow_the_sql(spark, tmp_path, name):
    for table in TABLES:
        if table != "benchmark":
            (tmp_path / f"{table}.parquet").symlink_to(FOLDER / f"{table}.parquet")
    benchmark = pq.read_table(FOLDER / "benchmark.parquet")
    more = pa.Table.from_pylist([{"item_id": 900_000, "text": "Co inin."}], schema=benchmark.schema)
    pq.write_table(pa.concat_tables([benchmark, more]), tmp_path / "benchmark.parquet")
    item = load_queries()[name]
    expected = sql_bag(connect(str(tmp_path)), item.sql)
    assert sum(row[expected[0].index("question_id")] == 900_000 for row in expected[1]) == 5
    assert compare(spark_bag(item.run(spark, str(tmp_path))), expected) is None


def test_scores_are_rounded_as_the_sql_rounds(spark):
    scores = [0.2542925, 0.5042895, 0.1284425, 0.2500005]
    vectors = spark.createDataFrame(
        [("d", f"c{i}", i, [s, math.sqrt(1.0 - s * s)]) for i, s in enumerate(scores)],
        "document_id string, chunk_id string, chunk_index int, embedding array<double>",
    )
    chunks = vectors.selectExpr(
        "*", "0 AS section_index", "'' AS section_title", "'' AS text", "1 AS page_number", "1 AS paragraph_index"
    ).drop("embedding")
    questions = spark.createDataFrame([(1, "d", [1.0, 0.0])], "question_id bigint, document_id string, embedding array<double>")
    found = {r["chunk_index"]: r["score"] for r in retrieve(questions, vectors, chunks).collect()}
    expected = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [s]).fetchone()[0] for s in scores]
    assert [found[i] for i in range(len(scores))] == expected
