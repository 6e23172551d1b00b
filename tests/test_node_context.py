"""Contexts at the edges of the SQL: many turns, little or no text to sum up, tokens that cancel."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from cartulary.operators import tree as T
from cartulary.plans import load_queries
from tests.oracle import TABLES, compare, connect, spark_bag, sql_bag

FOLDER = Path("/root/testdata/sf0.001")


def _turns(conversation, *texts):
    return [
        {"conv_id": conversation, "turn": i, "role": "user" if i % 2 == 0 else "assistant", "text": text}
        for i, text in enumerate(texts)
    ]


def test_odd_conversations_follow_the_sql(spark, tmp_path):
    for table in TABLES:
        if table != "conversations":
            (tmp_path / f"{table}.parquet").symlink_to(FOLDER / f"{table}.parquet")
    rich = "The harbour keeps its boats, and user matters are told below."
    odd = {
        900_000: ("Y à la é ü.", rich, "A second user asks about boats and harbours."),  # too few words for a summary
        900_001: ("Co inin.", rich, "Co inin."),  # tokens that cancel, in the question's node and elsewhere
        900_002: ("  ", rich, rich),
        900_003: (None, rich, rich),
        900_005: [f"Turn {i} tells about matter {i * 7 % 31} of user {i}." for i in range(140)],
        900_008: [f"Turn {i} tells about matter {i * 7 % 31}." for i in range(150)],
        900_013: ("Y la.", rich, "Co inin.", rich),
    }
    told = [turn for conversation, texts in odd.items() for turn in _turns(conversation, *texts)]
    given = pq.read_table(FOLDER / "conversations.parquet")
    more = pa.Table.from_pylist(told, schema=given.schema)
    pq.write_table(pa.concat_tables([given, more]), tmp_path / "conversations.parquet")
    item = load_queries()["node_context"]
    expected = sql_bag(connect(str(tmp_path)), item.sql)
    found = {row[expected[0].index("question_id")] for row in expected[1]}
    assert {str(c) for c in odd} <= found
    assert compare(spark_bag(item.run(spark, str(tmp_path))), expected) is None


def test_the_first_children_are_those_of_all(spark):
    rows = [("n", None, 0, "root")] + [(f"c{i:02d}", "n", i * 2, f"t{i}") for i in range(30)]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, position int, title string").selectExpr("*", "title AS summary")
    listed = lambda frame, name: {r["node_id"]: [c["title"] for c in r[name]] for r in frame.collect()}
    assert listed(T.children(nodes, 8), "children") == {"n": [f"t{i}" for i in range(8)]}
    whole = listed(T.siblings(nodes), "siblings")
    assert listed(T.siblings(nodes, 6), "siblings") == {k: v[:6] for k, v in whole.items()} and len(whole["c00"]) == 29
