"""Conversations that are too wide for a stored tree: the queries show all of their turns, as the SQL does."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cartulary.operators import outline as O
from cartulary.plans import load_queries
from tests.oracle import TABLES, compare, connect, spark_bag, sql_bag

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with a conversation of 70 turns of one level and one of 70 turns below the first."""
    place = tmp_path_factory.mktemp("wide")
    for table in TABLES:
        if table != "conversations":
            (place / f"{table}.parquet").symlink_to(FOLDER / f"{table}.parquet")
    turns = [(900_000, i, "user" if i % 2 == 0 else "assistant") for i in range(140)]
    turns += [(900_001, i, "user" if i else "system") for i in range(71)]
    told = [{"conv_id": c, "turn": i, "role": r, "text": f"Turn {i} tells about matter {i * 7 % 31}."} for c, i, r in turns]
    given = pq.read_table(FOLDER / "conversations.parquet")
    pq.write_table(pa.concat_tables([given, pa.Table.from_pylist(told, schema=given.schema)]), place / "conversations.parquet")
    return str(place)


@pytest.mark.parametrize("name", ["edge_evidence", "edited_paths", "map_json", "map_nodes", "tree_json"])
def test_wide_conversations_follow_the_sql(spark, folder, name):
    item = load_queries()[name]
    expected = sql_bag(connect(folder), item.sql)
    assert any("900000" in row for row in expected[1]) and any("900001" in row for row in expected[1])
    assert compare(spark_bag(item.run(spark, folder)), expected) is None


def test_every_child_has_a_position(spark):
    """More children than a block of the scan holds."""
    rows = spark.range(9000).selectExpr("'d' AS document_id", "CAST(id AS INT) AS section_index", "IF(id = 0, 1, 2) AS level")
    placed = O.place_sections(rows, whole=True)
    assert placed.filter("section_index > 0 AND path = concat('0.', section_index - 1)").count() == 8999
