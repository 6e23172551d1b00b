"""Chunks and questions to vectors."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.digest import term_counts
from cartulary.functions.text import explode_once, let
from cartulary.functions.vectors import embedding_tokens, hash_vector, model_name
from cartulary.session import settle


def token_weights(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(key, token, occurrences, weight)`` with weight ``1 + ln(occurrences)``.

    Tokens are counted inside their row. Only rows that share their key are grouped, so no task holds the tokens of
    all its texts, and those of a text whose key is its own are not shuffled.
    """
    shared = settle(texts.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").select(*key))

    def counted(rows: DataFrame) -> DataFrame:
        pairs = let(term_counts(embedding_tokens(F.col(text))), lambda c: F.arrays_zip(c["terms"], c["counts"]))
        found = explode_once(rows, key, pairs, "found")
        return found.select(*key, F.col("found.terms").alias("token"), F.col("found.counts").alias("occurrences"))

    if shared.isEmpty():
        counts = counted(texts)
    else:
        # Null keys are equal here, as they are in a grouping.
        same = reduce(and_, [texts[k].eqNullSafe(shared[k]) for k in key])
        together = counted(texts.join(shared, same, "left_semi")).groupBy(*key, "token")
        counts = counted(texts.join(shared, same, "left_anti")).unionByName(together.agg(F.sum("occurrences").alias("occurrences")))
    return counts.withColumn("weight", 1.0 + F.log("occurrences"))


def embed(
    texts: DataFrame, text: str = "text", settings: Settings = DEFAULTS, *, family: str = "blake2b"
) -> DataFrame:
    """Add ``embedding`` to every row; map-only."""
    udf = hash_vector(settings.embedding_dimensions, family)
    return texts.withColumn("embedding", udf(embedding_tokens(F.col(text))))


def vector_records(chunks: DataFrame, settings: Settings = DEFAULTS, *, family: str = "blake2b") -> DataFrame:
    """Rows of the vector table: id, document, vector, text and a string map of metadata."""
    metadata = F.map_filter(
        F.create_map(
            F.lit("document_id"),
            F.col("document_id").cast("string"),
            F.lit("section_index"),
            F.col("section_index").cast("string"),
            F.lit("chunk_index"),
            F.col("chunk_index").cast("string"),
            F.lit("page_number"),
            F.col("page_number").cast("string"),
            F.lit("paragraph_index"),
            F.col("paragraph_index").cast("string"),
        ),
        lambda _, value: value.isNotNull(),
    )
    return embed(chunks, "text", settings, family=family).select(
        "chunk_id",
        "document_id",
        "chunk_index",
        "embedding",
        "text",
        metadata.alias("metadata"),
        F.lit(model_name(settings.embedding_dimensions)).alias("embedding_model"),
    )
