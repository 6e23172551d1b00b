"""Chunking, ids, counts, status and alignment over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators.chunks import chunk_sections, chunks_aligned, count_chunks, document_status
from cartulary.plans.catalogue import query
from cartulary.plans.inputs import (
    SQL_CONVERSATION_SECTIONS,
    SQL_DOCUMENT_SECTIONS,
    SQL_SOURCE_SECTIONS,
    conversation_sections,
    document_sections,
    source_sections,
    sql_spans,
    sql_uuid5,
)
from cartulary.sources.tables import read_table

_CHUNK_COLUMNS = (
    "chunk_id",
    "document_id",
    "section_index",
    "chunk_index",
    "section_title",
    "text",
    "character_count",
    "char_start",
    "char_end",
)


def _sql_chunks(sections: str, name: str) -> str:
    return f"""
WITH {sections}, {sql_spans(name)}
SELECT {sql_uuid5("document_id || ':' || CAST(chunk_index AS VARCHAR)")} AS chunk_id,
       document_id, CAST(section_index AS INTEGER) AS section_index, CAST(chunk_index AS INTEGER) AS chunk_index,
       title AS section_title, text, CAST(length(text) AS INTEGER) AS character_count,
       CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end
FROM chunked"""


@query("chunk_documents", _sql_chunks(SQL_DOCUMENT_SECTIONS, "doc_sections"))
def chunk_documents(spark, folder):
    return chunk_sections(document_sections(spark, folder), single_section=True).select(*_CHUNK_COLUMNS)


@query("chunk_conversations", _sql_chunks(SQL_CONVERSATION_SECTIONS, "conv_sections"))
def chunk_conversations(spark, folder):
    return chunk_sections(conversation_sections(spark, folder)).select(*_CHUNK_COLUMNS)


@query("chunk_sources", _sql_chunks(SQL_SOURCE_SECTIONS, "source_sections"))
def chunk_sources(spark, folder):
    return chunk_sections(source_sections(spark, folder)).select(*_CHUNK_COLUMNS)


@query(
    "chunk_counts",
    f"""WITH {SQL_SOURCE_SECTIONS}, {sql_spans("source_sections")}
SELECT document_id, count(*) AS chunk_count FROM chunked GROUP BY document_id""",
)
def chunk_counts(spark, folder):
    chunks = chunk_sections(source_sections(spark, folder), single_section=True)
    return count_chunks(chunks)


@query(
    "document_status",
    f"""WITH {SQL_DOCUMENT_SECTIONS},
labelled AS (SELECT * FROM doc_sections
             WHERE CAST(document_id AS BIGINT) IN (SELECT doc_id FROM labels)), {sql_spans("labelled")}
SELECT d.document_id, coalesce(c.chunk_count, 0) AS chunk_count, c.embedding_model
FROM doc_sections d LEFT JOIN (
  SELECT document_id, count(*) AS chunk_count, 'deterministic-hashing-256' AS embedding_model
  FROM chunked GROUP BY document_id) c USING (document_id)""",
)
def document_status_query(spark, folder):
    """Only labelled documents have been indexed; the others report zero chunks."""
    sections = document_sections(spark, folder)
    labelled = read_table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    chunks = chunk_sections(
        sections.join(labelled, "document_id", "left_semi"),
        single_section=True,
        embedding_model="deterministic-hashing-256",
    )
    return document_status(sections.select("document_id"), chunks)


@query(
    "chunk_alignment",
    """SELECT CAST(conv_id AS VARCHAR) AS document_id, NOT bool_or(role = 'system') AS aligned
FROM conversations GROUP BY conv_id""",
)
def chunk_alignment(spark, folder):
    """The stored chunks were cut when system turns still counted as sections."""
    sections = conversation_sections(spark, folder)
    reparsed = sections.filter(~F.col("title").startswith("system"))
    documents = sections.select("document_id").distinct()
    return chunks_aligned(documents, reparsed, chunk_sections(sections, single_section=True))


@query(
    "chunk_paragraphs",
    """WITH RECURSIVE texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, replace(text, chr(10), chr(10) || chr(10)) AS text, string_split(text, chr(10)) AS lines FROM documents),
flat AS (
  SELECT document_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM texts),
placed AS (
  SELECT *, sum(length(line) + 2) OVER (PARTITION BY document_id ORDER BY i) - length(line) - 2 AS begins FROM flat),
blocks AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) AS b, begins AS first, begins + length(rtrim(line, chr(13))) AS last
  FROM placed WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
opened AS (
  SELECT *, CAST(greatest(ceil((last - first - 900) / 750.0), 0) AS BIGINT) AS cuts, first + greatest(ceil((last - first - 900) / 750.0), 0) * 750 AS start FROM blocks),
-- ends rise, so the first block that does not fit is the one after all that do
pointed AS (
  SELECT o.document_id, o.b, o.first, o.cuts, CAST(o.start AS BIGINT) AS start, o.last, max(n.b) + 1 AS following, max(n.last) AS close
  FROM opened o JOIN blocks n ON n.document_id = o.document_id AND n.b >= o.b AND n.last <= o.start + 900 GROUP BY ALL),
chain AS (
  SELECT * FROM pointed WHERE b = 1
  UNION ALL
  SELECT p.* FROM chain c JOIN pointed p ON p.document_id = c.document_id AND p.b = c.following),
spans AS (
  SELECT document_id, first + k * 750 AS start, first + k * 750 + 900 AS close FROM chain, LATERAL (SELECT unnest(range(0, cuts)) AS k)
  UNION ALL SELECT document_id, start, close FROM chain),
cut AS (
  SELECT document_id, start, close, trim(substr(text, CAST(start + 1 AS BIGINT), CAST(close - start AS BIGINT)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM spans JOIN texts USING (document_id))
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start) - 1 AS INTEGER) AS chunk_index,
  CAST(start AS INTEGER) AS char_start, CAST(close AS INTEGER) AS char_end, body AS text
FROM cut WHERE body <> ''""",
)
def chunk_paragraphs(spark, folder):
    """Every line a paragraph of its own, packed into windows; longer ones are cut."""
    sections = read_table(spark, folder, "documents", heavy=True).select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit(0).alias("section_index"),
        F.lit("text").alias("title"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
    return chunk_sections(sections, single_section=True).select("document_id", "chunk_index", "char_start", "char_end", "text")
