"""The corpus pipeline: good documents, one of each near-duplicate group, no repeated passages, no benchmark leaks,
packed into training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. Stages on word shingles use five words and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.decontam import clean_rows
from cartulary.llm.neardup import NearDupSettings, keep_one
from cartulary.llm.packing import pack
from cartulary.llm.quality import keep_good, learn
from cartulary.llm.suffix import Parsing, without_repeats
from cartulary.session import settle

#: Strings of this many words that occur elsewhere go: passages of over fifty words.
REPEATS = Parsing(length=51, trigger=4, step=4, words=True)
#: A link at 0.8 misses all 32 bands of 5 rows with a probability of 3e-6.
NEAR = NearDupSettings(width=5, share=80, bands=32, rows=5)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts."""
    return keep_good(docs, learn(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return keep_one(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over fifty words that occur elsewhere; ``n_chars`` follows the text.

    A null text stays null; a row that repeats another loses what both hold.
    """
    kept = without_repeats(docs, REPEATS)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_rows(docs, _table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("sequences", sequences),
]

#: Ranking, sketches, parsing and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
