"""Requests to, and guarded results from, a model that rewrites node summaries. The model itself is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.headings import numbering_prefix
from cartulary.functions.similarity import matching_ratio
from cartulary.functions.text import collapse, is_blank, strip
from cartulary.operators.ordered import Carry, running
from cartulary.session import settle

# Limits and prompt texts.
SOURCE_CHARACTERS = 1200
TARGETS_PER_BATCH = 24
SUMMARY_CHARACTERS = 300
KEYWORDS = 6
TITLE_LENGTH_DELTA = 4
TITLE_SIMILARITY = 0.6
ENRICHMENT_VERSION = "node-enrichment-v1"
EXTRACTION_VERSION = "knowledge-tree-v2"


def targets(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """``(document_id, path, title, preorder, text)`` of every node whose sections have text."""
    # A section can only contribute its first 1200 characters to any node.
    short = sections.select(
        "document_id", "section_index", F.substring(collapse(F.col("text")), 1, SOURCE_CHARACTERS).alias("body")
    ).filter(F.col("body") != "")
    wanted = nodes.filter("depth > 0").select(
        "document_id", "path", "title", "preorder", F.posexplode("section_indexes").alias("place", "section_index")
    )
    return (
        wanted.join(short, ["document_id", "section_index"])
        .groupBy("document_id", "path", "title", "preorder")
        .agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("parts"))
        .select(
            "document_id",
            "path",
            "title",
            "preorder",
            F.substring(F.array_join(F.transform("parts", lambda p: p["body"]), "\n"), 1, SOURCE_CHARACTERS).alias("text"),
        )
    )


def batches(found: DataFrame) -> DataFrame:
    """Add ``chapter`` and ``batch``: at most 24 targets of one top-level chapter."""
    keyed = found.withColumn("chapter", F.split("path", r"\.")[0].cast("int"))
    placed = running(keyed, ["document_id", "chapter"], "preorder", [Carry("__before", F.lit(1), "sum")])
    return placed.withColumn("batch", F.floor(F.col("__before") / F.lit(TARGETS_PER_BATCH)).cast("int")).drop("__before")


def enrichment_prompts(batched: DataFrame) -> DataFrame:
    """One prompt per batch."""
    block = F.concat(
        F.lit("[node_id="), F.col("path"), F.lit(' | title="'), F.col("title"), F.lit('"]\n'), F.col("text")
    )
    grouped = batched.groupBy("document_id", "chapter", "batch").agg(
        F.count("*").alias("target_count"), F.sort_array(F.collect_list(F.struct("preorder", block.alias("block")))).alias("blocks")
    )
    return grouped.select(
        "document_id",
        "chapter",
        "batch",
        "target_count",
        F.concat(
            F.lit(f"Prompt version: {ENRICHMENT_VERSION}\n\nSummarise each node and give its keywords:\n<nodes>\n"),
            F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"),
            F.lit("\n</nodes>"),
        ).alias("prompt"),
    )


def extraction_prompts(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """One prompt per document with all of its non-blank sections."""
    block = F.concat(
        F.lit("[Section | index="),
        F.col("section_index").cast("string"),
        F.lit(" | title="),
        F.col("title"),
        F.lit(" | level="),
        F.col("level").cast("string"),
        F.lit("]\n"),
        F.col("text"),
    )
    grouped = (
        sections.filter(~is_blank(F.col("text")))
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("section_index", block.alias("block")))).alias("blocks"))
    )
    return grouped.join(titles, "document_id").select(
        "document_id",
        F.concat(
            F.lit(f"Prompt version: {EXTRACTION_VERSION}\nDocument title: "),
            F.col("title"),
            F.lit("\n\nExtract the knowledge tree from the following document text:\n<document_text>\n"),
            F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"),
            F.lit("\n</document_text>"),
        ).alias("prompt"),
    )


def accepted_titles(pairs: DataFrame) -> DataFrame:
    """Rows of (key, title, candidate) whose candidate clearly repairs the same heading.

    The similarity is computed last, only for the rows that pass the cheap guards.
    """
    cleaned = pairs.withColumn("candidate", collapse(F.col("candidate")))
    passed = cleaned.filter(
        (F.col("candidate") != "")
        & (F.col("candidate") != F.col("title"))
        & (F.abs(F.length("candidate") - F.length("title")) <= TITLE_LENGTH_DELTA)
        & (numbering_prefix(F.col("candidate")) == numbering_prefix(F.col("title")))
    )
    return passed.withColumn("ratio", matching_ratio("title", "candidate")).filter(F.col("ratio") >= TITLE_SIMILARITY)


def accepted_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Model rows that pass the guards: known node, summary of sane length, at most six keywords.

    ``rows``: document_id, node_id (the path), summary, keywords, corrected_title. A repeated node keeps the
    row that sorts last by ``row_no`` when there is one, then by its content.
    """
    known = rows.join(
        found.select("document_id", F.col("path").alias("node_id"), F.col("title").alias("title")), ["document_id", "node_id"]
    ).withColumn("summary", collapse(F.col("summary")))
    fine = known.filter((F.length("summary") > 0) & (F.length("summary") <= SUMMARY_CHARACTERS))
    kept = F.slice(
        F.filter(F.transform("keywords", lambda k: strip(k)), lambda k: k != ""), 1, KEYWORDS
    )
    order = F.col("row_no") if "row_no" in rows.columns else F.lit(0)
    latest = (
        fine.withColumn("keywords", F.coalesce(kept, F.array().cast("array<string>")))
        .groupBy("document_id", "node_id", "title")
        .agg(F.max_by(F.struct("summary", "keywords", "corrected_title"), F.struct(order, "summary", "keywords", "corrected_title")).alias("r"))
        .select("document_id", "node_id", "title", "r.summary", "r.keywords", "r.corrected_title")
    )
    latest = settle(latest)
    repaired = accepted_titles(
        latest.filter(F.col("corrected_title").isNotNull()).select(
            "document_id", "node_id", "title", F.col("corrected_title").alias("candidate")
        )
    ).select("document_id", "node_id", F.col("candidate").alias("corrected_title"))
    return latest.drop("corrected_title", "title").join(repaired, ["document_id", "node_id"], "left")


def apply_rows(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """Overlay accepted rows over the outline; other nodes keep their extractive text."""
    rows = accepted.select(
        "document_id",
        F.col("node_id").alias("path"),
        F.col("summary").alias("__summary"),
        F.col("keywords").alias("__keywords"),
        F.col("corrected_title").alias("__title"),
    )
    return (
        nodes.join(rows, ["document_id", "path"], "left")
        .withColumn("title", F.coalesce("__title", "title"))
        .withColumn("summary", F.coalesce("__summary", "summary"))
        .withColumn(
            "keywords", F.when(F.size("__keywords") > 0, F.col("__keywords")).otherwise(F.col("keywords"))
        )
        .select(*nodes.columns)
    )


def tree_modes(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """``llm`` for documents with at least one accepted row, else ``structure_fallback``."""
    touched = accepted.select("document_id").distinct().withColumn("__hit", F.lit(True))
    return nodes.select("document_id").distinct().join(touched, "document_id", "left").select(
        "document_id", F.when(F.col("__hit"), "llm").otherwise("structure_fallback").alias("tree_mode")
    )
