"""The given tables seen as documents, sections and questions, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.sources.tables import read_table


def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is one section."""
    return read_table(spark, folder, "documents", heavy=True).select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit(0).alias("section_index"),
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"),
        F.lit(1).alias("level"),
        "text",
    )


def source_sections(spark: SparkSession, folder: str) -> DataFrame:
    """A source is a document and each of its texts a section, so a document has very many sections."""
    return read_table(spark, folder, "documents", heavy=True).select(
        F.col("source").alias("document_id"),
        F.col("doc_id").alias("section_index"),
        F.concat(F.col("lang"), F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
        F.lit(1).alias("level"),
        "text",
    )


def conversation_sections(spark: SparkSession, folder: str) -> DataFrame:
    """A conversation is a document, a turn is a section, and the role sets the level."""
    return read_table(spark, folder, "conversations", heavy=True).select(
        F.col("conv_id").cast("string").alias("document_id"),
        F.col("turn").cast("int").alias("section_index"),
        F.concat(F.col("role"), F.lit(" "), F.col("turn").cast("string")).alias("title"),
        F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3).alias("level"),
        "text",
    )


def source_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark text asks one source, chosen by its number."""
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_id"),
        F.concat(F.lit("node-"), (F.col("item_id") % 20).cast("string")).alias("node_id"),
        "text",
    )


SQL_CONVERSATION_SECTIONS = """
conv_sections AS (
  SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS section_index,
         role || ' ' || CAST(turn AS VARCHAR) AS title,
         CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, text
  FROM conversations)"""


def sql_spans(source: str) -> str:
    """Windows of texts without blank lines, for a relation with document_id, section_index, title, text."""
    return f"""
sized AS (SELECT *, length(rtrim(text, chr(10) || chr(13))) AS n FROM {source}),
spans AS (
  SELECT document_id, section_index, title, text, i AS span_no, 750 * i AS char_start,
         CASE WHEN i = greatest(0, CAST(ceil((n - 900) / 750.0) AS BIGINT)) THEN n ELSE 750 * i + 900 END AS char_end
  FROM sized, LATERAL (
    SELECT unnest(generate_series(0, greatest(0, CAST(ceil((n - 900) / 750.0) AS BIGINT)))) AS i)),
cut AS (
  SELECT document_id, section_index, title, span_no, char_start, char_end,
         trim(substring(text, char_start + 1, char_end - char_start), ' ' || chr(9) || chr(10) || chr(13)) AS text
  FROM spans),
chunked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_index, span_no) - 1 AS chunk_index
  FROM cut WHERE text <> '')"""


def sql_uuid5(name: str) -> str:
    digest = f"sha1(unhex('6f5a1f5f1f0f4d0a9c1f5b1d4f7c9a10') || encode({name}))"
    return f"""(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' ||
      translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' ||
      substr({digest}, 21, 12))"""


SQL_DOCUMENT_SECTIONS = """
doc_sections AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS section_index,
         'document ' || CAST(doc_id AS VARCHAR) AS title, text FROM documents)"""

SQL_SOURCE_SECTIONS = """
source_sections AS (
  SELECT source AS document_id, doc_id AS section_index, lang || ' ' || CAST(doc_id AS VARCHAR) AS title, text
  FROM documents)"""
