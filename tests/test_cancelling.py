"""Texts whose tokens cancel in every cell: the SQL divides zero by zero, and NaN ranks before all scores."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cartulary.plans import load_queries
from tests.oracle import TABLES, compare, connect, spark_bag, sql_bag

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with one more text in two sources: two words of one cell and opposite signs."""
    place = tmp_path_factory.mktemp("cancelling")
    for table in TABLES:
        if table != "documents":
            (place / f"{table}.parquet").symlink_to(FOLDER / f"{table}.parquet")
    documents = pq.read_table(FOLDER / "documents.parquet")
    more = pa.Table.from_pylist(
        [{"doc_id": 900_000 + i, "text": "Co inin.", "lang": "en", "source": f"src{i}", "n_chars": 8} for i in (0, 1)],
        schema=documents.schema,
    )
    pq.write_table(pa.concat_tables([documents, more]), place / "documents.parquet")
    return str(place)


@pytest.mark.parametrize(
    "name", ["hash_embedding_md5", "retrieval_threshold", "retrieve_boosted", "retrieve_documents"]
)
def test_cancelled_texts_follow_the_sql(spark, folder, name):
    item = load_queries()[name]
    expected = sql_bag(connect(folder), item.sql)
    assert any(None in row for row in expected[1]), "no NaN in the SQL's rows"
    assert compare(spark_bag(item.run(spark, folder)), expected) is None
