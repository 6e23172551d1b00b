"""Vectors, scoped search, boosting and skew in the search."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cartulary.config import Settings
from cartulary.functions.vectors import cosine, embedding_tokens
from cartulary.operators.embedding import embed, vector_records
from cartulary.operators.retrieval import index_drift, retrieve, scoped_candidates


def test_tokens(spark):
    frame = spark.createDataFrame([("Data-2 data Iechä 数据协，同",)], "text string")
    got = frame.select(embedding_tokens(F.col("text")).alias("t")).first()["t"]
    assert sorted(got) == sorted(["data", "2", "data", "iech", "数", "据", "协", "同", "数据", "据协"])


def test_hash_embedding_places_and_signs_tokens(spark):
    frame = spark.createDataFrame([("alpha alpha beta",), ("",)], "text string")
    got = [r["embedding"] for r in embed(frame, settings=Settings(embedding_dimensions=16)).collect()]
    want = [0.0] * 16
    for token, count in (("alpha", 2), ("beta", 1)):
        raw = hashlib.blake2b(token.encode(), digest_size=8).digest()
        want[int.from_bytes(raw[:4], "big") % 16] += (1 if raw[4] % 2 == 0 else -1) * (1 + math.log(count))
    norm = math.sqrt(sum(x * x for x in want))
    assert got[0] == pytest.approx([x / norm for x in want]) and got[1] == [0.0] * 16


def test_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in frame.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [pytest.approx(0.5**0.5), 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimensions"):
        bad.select(cosine(F.col("a"), F.col("b"))).collect()


def test_search_in_blocks_equals_brute_force(spark):
    rng = random.Random(11)
    vector = lambda: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(6)]
    # One document holds most chunks and most questions.
    chunks = [("hot" if i % 5 else "cold", f"c{i}", i, vector()) for i in range(300)]
    questions = [(i, "hot" if i % 7 else "cold", vector()) for i in range(60)]
    got = scoped_candidates(
        spark.createDataFrame(questions, "question_id long, document_id string, embedding array<double>"),
        spark.createDataFrame(chunks, "document_id string, chunk_id string, chunk_index int, embedding array<double>"),
        Settings(vector_block=32, question_block=8),
        limit=7,
    ).collect()

    def score(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) + 0.0 if n else 0.0

    for question_id, document, q in questions:
        want = sorted(((-score(q, v), i) for d, _, i, v in chunks if d == document))[:7]
        mine = sorted((r["rank"], r["chunk_index"]) for r in got if r["question_id"] == question_id)
        assert [i for _, i in mine] == [i for _, i in want]


def test_boost_threshold_and_drift(spark):
    rows = [("d", 0, "citation evidence for retrieval", "a"), ("d", 1, "citation evidence for answers", "b"), ("d", 2, "unrelated words only", "c"), ("e", 0, "citation evidence for retrieval", "x")]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, text string, chunk_id string").select(
        "*", F.lit(0).alias("section_index"), F.lit("S").alias("section_title"), F.lit(None).cast("int").alias("page_number"), F.lit(1).alias("paragraph_index")
    )
    vectors = vector_records(chunks)
    question = embed(spark.createDataFrame([(1, "d", "n", "citation evidence for retrieval")], "question_id int, document_id string, node_id string, text string"))
    plain = retrieve(question, vectors, chunks).orderBy("rank").collect()
    assert [r["chunk_id"] for r in plain] == ["a", "b"] and plain[0]["scope"] == "document" and plain[0]["location"] == "¶2"
    evidence = spark.createDataFrame([("n", "b"), ("n", "b"), ("n", "c")], "node_id string, chunk_id string")
    boosted = retrieve(question, vectors, chunks, evidence, boost=0.9).orderBy("rank").collect()
    assert [(r["chunk_id"], r["scope"]) for r in boosted] == [("b", "node_evidence"), ("a", "document")]
    assert retrieve(question, vectors, chunks.filter("chunk_id <> 'a'")).count() == 1
    assert [r["chunk_id"] for r in index_drift(vectors, chunks.filter("chunk_id <> 'a'")).collect()] == ["a"]
    assert retrieve(question, vectors, chunks, top_k=-1).count() == 0
