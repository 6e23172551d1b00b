"""Shards: every row once, within the limit, no shard that needed no split; SQL equivalent."""

from collections import Counter, defaultdict

from cartulary.llm.sharding import ORACLE, assign_shards
from tests.oracle import compare, connect, spark_bag, sql_bag

SCHEMA = "doc_id long, text string, depth int, prefix string"


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert compare(spark_bag(assign_shards(docs)), sql_bag(connect(folder), ORACLE)) is None


def test_limits_and_overflow(spark):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(7, "same text")] * 300 + [(None, None), (500, ""), (501, "y" * 5000)]
    docs = spark.createDataFrame([(d, t, 1, "p") for d, t in rows], SCHEMA).repartition(4)
    for limit in (200, 1000, 10**6):
        found = assign_shards(docs, limit).collect()
        assert Counter((r[0], r[1]) for r in found) == Counter((d, len(t or "")) for d, t in rows)
        held = defaultdict(list)
        for r in found:
            held[(r["depth"], r["prefix"], r["page"])].append(r)
        for group in held.values():
            size = sum(r["n_bytes"] for r in group)
            assert {r["shard_bytes"] for r in group} == {size}
            assert size <= limit or sum(1 for r in group if r["n_bytes"]) == 1
        parents = Counter()
        for r in found:
            if r["depth"]:
                parents[(r["depth"], r["prefix"] >> 1)] += 1
        assert limit < 10**6 or len(held) == 1
    assert assign_shards(docs.limit(0)).count() == 0
