"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of each node move to the least of them (larger ones, or smaller ones and itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is its least node.

    Nulls and self-links are ignored, repeated links count once; no links give no rows. Every step is a grouped
    minimum and a join, so no component is gathered anywhere.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        edges = settle(_stars(_stars(edges, True), False))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups(node, component)`` after more ``links(a, b)``; nodes that are in no group stand for themselves.

    Only links between different groups count, so where there are few of them the work is small.
    """
    named = groups.select("node", "component")
    ends = links
    for end in ("a", "b"):
        own = named.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
        ends = ends.join(own, end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))
    contracted = settle(
        ends.where("a_component <> b_component").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    )
    if contracted.isEmpty():
        return groups
    joined = components(contracted).select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = named.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # a group's own name is a node of it; lone nodes come in through the links
    lone = joined.select(F.col("component").alias("node"), F.col("least").alias("component")).join(named, "node", "left_anti")
    return settle(moved.unionByName(lone))
