"""Held-out accuracy and defined cases of the quality ranking."""

import zlib

from cartulary.llm.quality import CUT, keep_good, learn, quality_scores

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    found = quality_scores(docs, labels).cache()
    assert found.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found.collect())
    held = found.where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= CUT) for r in held)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, quality int, score string"
    rows = [(1, None, "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (None, "a b", None, None, None, None), (2, "w " * 100_000, "en", "s", 1, "")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    found = quality_scores(docs, labels).collect()
    assert len(found) == 4 and len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    assert quality_scores(docs.limit(0), labels).count() == 0
    unlabelled = quality_scores(docs, labels.limit(0)).collect()
    assert [r["predicted"] for r in unlabelled] == [1] * 4
    assert keep_good(docs, learn(docs, labels.limit(0))).columns == docs.columns
