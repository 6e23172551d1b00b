"""Links from nodes, edges and answers to the chunks that support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.ids import edge_id

TARGET_NODE = "knowledge_node"
TARGET_EDGE = "knowledge_edge"
TARGET_ANSWER = "answer"
RELATION = "contains"


def make_links(
    targets: DataFrame,
    target_type: str,
    *,
    chunk_ids: str = "chunk_ids",
    section: Column | None = None,
    relevance: Column | None = None,
) -> DataFrame:
    """One row per chunk of ``(document_id, target_id, chunk_ids)``, ranked from 1 in list order."""
    section = F.lit(None) if section is None else section
    relevance = F.lit(None) if relevance is None else relevance
    return targets.select(
        "document_id",
        "target_id",
        section.cast("int").alias("source_section_index"),
        relevance.cast("double").alias("relevance"),
        F.posexplode(chunk_ids).alias("__at", "chunk_id"),
    ).select(
        "document_id",
        "chunk_id",
        F.lit(target_type).alias("target_type"),
        "target_id",
        "source_section_index",
        (F.col("__at") + 1).alias("rank"),
        "relevance",
        F.lit(None).cast("string").alias("quote"),
    )


def make_edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent_id").isNotNull()).select(
        edge_id(F.col("document_id"), F.col("path")).alias("edge_id"),
        "document_id",
        F.col("parent_id").alias("parent_node_id"),
        F.col("node_id").alias("child_node_id"),
        F.lit(RELATION).alias("relation"),
    )


def _ranked_chunks(chunks: DataFrame, limit: int) -> DataFrame:
    """The first chunks of every section; the ranked filter bounds what a long section shuffles."""
    order = Window.partitionBy("document_id", "section_index").orderBy("chunk_index")
    return (
        chunks.select("document_id", "section_index", "chunk_index", "chunk_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
    )


def link_nodes(nodes: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Node evidence: the first 12 chunks of each covered section, for the root 50 of every section."""
    ranked = _ranked_chunks(chunks, settings.root_evidence_chunks)
    wanted = nodes.filter("depth > 0").select(
        "document_id", F.col("node_id").alias("target_id"), F.explode("section_indexes").alias("section_index")
    )
    branch = wanted.join(
        ranked.filter(F.col("rank") <= settings.node_evidence_chunks), ["document_id", "section_index"]
    )
    root = nodes.filter("depth = 0").select("document_id", F.col("node_id").alias("target_id")).join(
        ranked, "document_id"
    )
    columns = ["document_id", "target_id", "section_index", "chunk_index", "chunk_id", "rank"]
    return branch.select(*columns).unionByName(root.select(*columns)).select(
        "document_id",
        "chunk_id",
        F.lit(TARGET_NODE).alias("target_type"),
        "target_id",
        F.col("section_index").cast("int").alias("source_section_index"),
        "rank",
        F.lit(None).cast("double").alias("relevance"),
        F.lit(None).cast("string").alias("quote"),
        "chunk_index",
    )


def link_edges(
    edges: DataFrame, node_links: DataFrame, settings: Settings = DEFAULTS, *, whole: bool = False
) -> DataFrame:
    """Edge evidence: the first 12 links of the child by (rank, section, chunk), or all of them if ``whole``."""
    order = Window.partitionBy("target_id").orderBy("rank", "source_section_index", "chunk_index")
    placed = node_links.filter(F.col("target_type") == TARGET_NODE).withColumn("__n", F.row_number().over(order))
    taken = placed if whole else placed.filter(F.col("__n") <= settings.node_evidence_chunks)
    first = taken.select(F.col("target_id").alias("child_node_id"), "chunk_id", F.col("__n").alias("rank"))
    return edges.join(first, "child_node_id").select(
        "document_id",
        "chunk_id",
        F.lit(TARGET_EDGE).alias("target_type"),
        F.col("edge_id").alias("target_id"),
        F.lit(None).cast("int").alias("source_section_index"),
        "rank",
        F.lit(None).cast("double").alias("relevance"),
        F.lit(None).cast("string").alias("quote"),
    )


def link_evidence(
    nodes: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """``(edges, links)`` of a tree; links cover nodes and edges."""
    edges = make_edges(nodes)
    node_links = link_nodes(nodes, chunks, settings)
    return edges, node_links.drop("chunk_index").unionByName(link_edges(edges, node_links, settings))


def citations(links: DataFrame, chunks: DataFrame, target_type: str) -> DataFrame:
    """Links of one kind with their live chunks; read them in rank order."""
    return links.filter(F.col("target_type") == target_type).join(
        chunks.select(
            "chunk_id",
            "chunk_index",
            "section_title",
            "page_number",
            "paragraph_index",
            F.col("text").alias("chunk_text"),
        ),
        "chunk_id",
    )


def chunk_ids_by_target(links: DataFrame, target_type: str) -> DataFrame:
    """Linked chunk ids per target in rank order, one array per target."""
    return (
        links.filter(F.col("target_type") == target_type)
        .groupBy("target_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("rank", F.coalesce("source_section_index", F.lit(-1)).alias("section"), "chunk_id")
                )
            ).alias("__ordered")
        )
        .select("target_id", F.transform("__ordered", lambda x: x["chunk_id"]).alias("chunk_ids"))
    )


def node_sections(links: DataFrame) -> DataFrame:
    """Distinct evidence sections per node, ascending."""
    return (
        links.filter((F.col("target_type") == TARGET_NODE) & F.col("source_section_index").isNotNull())
        .select("document_id", "target_id", "source_section_index")
        .distinct()
        .groupBy("document_id", F.col("target_id").alias("node_id"))
        .agg(F.sort_array(F.collect_list("source_section_index")).alias("evidence_sections"))
    )
