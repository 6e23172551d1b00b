"""Sections to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.chunking import split_text
from cartulary.functions.ids import chunk_id
from cartulary.functions.text import explode_once, primary_page, primary_paragraph
from cartulary.operators.ordered import Carry, running
from cartulary.session import settle


def with_spans(sections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return sections.withColumn(
        "spans", split_text(F.col("text"), settings.chunk_max_characters, settings.chunk_overlap_characters)
    )


def section_offsets(spanned: DataFrame) -> DataFrame:
    """``(document_id, section_index, first_chunk_index)``: how many chunks the earlier sections produce.

    Only counts are shuffled, never text, and documents are scanned in blocks of sections.
    """
    counts = spanned.select("document_id", "section_index", F.size("spans").alias("n_chunks"))
    return running(
        counts, ["document_id"], "section_index", [Carry("first_chunk_index", F.col("n_chunks"), "sum")]
    ).select("document_id", "section_index", F.col("first_chunk_index").cast("int").alias("first_chunk_index"))


def chunk_sections(
    sections: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    single_section: bool = False,
    embedding_model: str | None = None,
) -> DataFrame:
    """One row per chunk with a document-wide index and a stable id.

    ``sections`` holds document_id, section_index, title, text and, optionally, source_locations. With
    ``single_section`` the caller states that every document has one section, so nothing is shuffled.
    """
    located = "source_locations" in sections.columns
    page = primary_page(F.col("source_locations")) if located else F.lit(None)
    paragraph = primary_paragraph(F.col("source_locations")) if located else F.lit(None)
    base = with_spans(sections, settings).select(
        "document_id",
        "section_index",
        F.col("title").alias("section_title"),
        page.cast("int").alias("page_number"),
        paragraph.cast("int").alias("paragraph_index"),
        "spans",
    )
    if single_section:
        placed = base.withColumn("first_chunk_index", F.lit(0))
    else:
        base = settle(base)
        placed = base.join(section_offsets(base), ["document_id", "section_index"])
    kept = [c for c in placed.columns if c != "spans"]
    exploded = explode_once(placed, kept, F.col("spans"), "span", "span_no")
    index = (F.col("first_chunk_index") + F.col("span_no")).cast("int")
    return exploded.select(
        chunk_id(F.col("document_id"), index).alias("chunk_id"),
        "document_id",
        F.col("section_index").cast("int").alias("section_index"),
        index.alias("chunk_index"),
        (F.col("span_no") + 1).cast("int").alias("section_rank"),
        "section_title",
        F.col("span.text").alias("text"),
        F.length("span.text").alias("character_count"),
        F.col("span.start").alias("char_start"),
        F.col("span.end").alias("char_end"),
        "page_number",
        "paragraph_index",
        F.lit(embedding_model).cast("string").alias("embedding_model"),
    )


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def document_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunk count and embedding model; documents without chunks count zero."""
    facts = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.min("embedding_model").alias("embedding_model")
    )
    return documents.join(facts, "document_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long"))
    )


def chunks_aligned(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: do all chunks point at a section of the same title? No chunks means no."""
    checked = (
        chunks.select("document_id", "section_index", "section_title")
        .join(
            sections.select("document_id", "section_index", F.col("title").alias("__title")),
            ["document_id", "section_index"],
            "left",
        )
        .groupBy("document_id")
        .agg(F.bool_and(F.coalesce(F.col("__title") == F.col("section_title"), F.lit(False))).alias("aligned"))
    )
    return documents.select("document_id").join(checked, "document_id", "left").select(
        "document_id", F.coalesce("aligned", F.lit(False)).alias("aligned")
    )
