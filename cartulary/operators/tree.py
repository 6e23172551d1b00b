"""Reading a stored tree: relatives, subtrees, search, visibility, map model and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.text import explode_once, strip
from cartulary.operators.evidence import node_sections
from cartulary.operators.ordered import neighbour
from cartulary.session import settle

MAP_SCHEMA = "knowledge-map-v1"
SEARCH_LIMIT = 20
_EMPTY_INTS = "array<int>"


def ancestor_paths(path: Column) -> Column:
    """``a.b.c`` to ``[a, a.b]``."""
    parts = F.split(path, r"\.")
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."),
    )


def ancestor_paths_with_root(path: Column) -> Column:
    """As ``ancestor_paths``, with the empty root path in front; nothing for the root itself."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.lit("")), ancestor_paths(path))
    )


def with_preorder(nodes: DataFrame) -> DataFrame:
    """Number the nodes of edited trees in preorder, root first.

    A node comes one place after its parent plus all nodes below its earlier siblings, so the number is a sum
    along the path; no group is larger than the children of one node or the depth of one path.
    """
    earlier = (
        Window.partitionBy("document_id", "__parent").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    )
    steps = (
        nodes.filter(F.col("path") != "")
        .select("document_id", "path", "position", parent_path(F.col("path")).alias("__parent"))
        .join(subtree_sizes(nodes).drop("leaf_count"), ["document_id", "path"])
        .select(
            "document_id",
            F.col("path").alias("__step"),
            (1 + F.coalesce(F.sum("node_count").over(earlier), F.lit(0))).alias("__offset"),
        )
    )
    chain = nodes.select(
        "document_id", "path", F.explode(F.array_append(ancestor_paths(F.col("path")), F.col("path"))).alias("__step")
    )
    numbers = (
        chain.join(steps, ["document_id", "__step"])
        .groupBy("document_id", "path")
        .agg(F.sum("__offset").alias("preorder"))
    )
    return (
        nodes.drop("preorder")
        .join(numbers, ["document_id", "path"], "left")
        .withColumn("preorder", F.coalesce("preorder", F.lit(0)).cast("int"))
    )


def tree_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("document_id", "depth", "position", "path")


def ancestors(nodes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(document_id, node_id, ancestors)`` with titles root first, the nearest ten."""
    chain = nodes.select(
        "document_id",
        "node_id",
        F.explode(F.slice(F.reverse(ancestor_paths_with_root(F.col("path"))), 1, settings.ancestor_limit)).alias("path"),
    )
    named = nodes.select("document_id", "path", "depth", F.col("title").alias("ancestor_title"))
    found = (
        chain.join(named, ["document_id", "path"])
        .groupBy("document_id", "node_id")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor_title"))).alias("__chain"))
    )
    return nodes.select("document_id", "node_id").join(found, ["document_id", "node_id"], "left").select(
        "document_id",
        "node_id",
        F.coalesce(F.transform("__chain", lambda x: x["ancestor_title"]), F.array().cast("array<string>")).alias(
            "ancestors"
        ),
    )


def children(nodes: DataFrame, first: int | None = None) -> DataFrame:
    """``(node_id, children)``: position, id, title and summary in order, of all children or the ``first``."""
    below = nodes.filter(F.col("parent_id").isNotNull())
    if first is not None:
        # A ranked filter is limited before the shuffle.
        nth = F.row_number().over(Window.partitionBy("parent_id").orderBy("position", "node_id"))
        below = below.withColumn("__nth", nth).filter(F.col("__nth") <= first)
    return (
        below.groupBy(F.col("parent_id").alias("node_id"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "node_id", "title", "summary"))).alias("children"))
    )


def siblings(nodes: DataFrame, first: int | None = None) -> DataFrame:
    """``(node_id, siblings)``: the parent's other children in order, all or the ``first``."""
    below = children(nodes, None if first is None else first + 1).withColumnRenamed("node_id", "parent_id")
    others = F.filter("children", lambda c: c["node_id"] != F.col("node_id"))
    return nodes.select("node_id", "parent_id").join(below, "parent_id", "left").select(
        "node_id",
        F.coalesce(
            others if first is None else F.slice(others, 1, first), F.expr("array()").cast("array<struct<position:int,node_id:string,title:string,summary:string>>")
        ).alias("siblings"),
    )


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent_id").isNull())


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Nodes and leaves at or below every node. Each node reports to its own path and its ancestors'."""
    reports = nodes.select(
        "document_id",
        (F.col("child_count") == 0).alias("leaf"),
        F.explode(F.array_append(ancestor_paths_with_root(F.col("path")), F.col("path"))).alias("path"),
    )
    return reports.groupBy("document_id", "path").agg(
        F.count("*").alias("node_count"), F.count_if(F.col("leaf")).alias("leaf_count")
    )


def is_descendant(path: Column, of: Column) -> Column:
    """Strict: a node is not its own descendant."""
    return F.when(of == "", path != "").otherwise(F.startswith(path, F.concat(of, F.lit("."))))


def subtree(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes at or below each target. ``targets``: (document_id, target_path)."""
    reports = nodes.select(
        "document_id",
        "node_id",
        F.col("path"),
        F.explode(F.array_append(ancestor_paths_with_root(F.col("path")), F.col("path"))).alias("target_path"),
    )
    return reports.join(targets, ["document_id", "target_path"])


def expandable(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("child_count") > 0).select("document_id", "node_id", "path")


def visible(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes whose ancestors are all expanded. ``expanded``: (document_id, path)."""
    chain = nodes.select(
        "document_id", "node_id", F.explode(ancestor_paths_with_root(F.col("path"))).alias("path")
    )
    hidden = (
        chain.join(expanded.select("document_id", "path"), ["document_id", "path"], "left_anti")
        .select("document_id", "node_id")
        .distinct()
    )
    return nodes.join(hidden, ["document_id", "node_id"], "left_anti")


def paths_from_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, ``depth`` and ``ancestors`` (node ids, root first) from parent links alone.

    ``nodes``: document_id, node_id, parent_id (null for a root), position. Every node points at its parent; in each
    round it takes over what the node it points at knows and points as far again, so a chain of 1,000 nodes needs ten
    rounds. Nodes below a missing parent or in a circle have no path.
    """
    key = ["document_id", "node_id"]
    own = F.when(F.col("parent_id").isNotNull(), F.array(F.col("position").cast("string"))).otherwise(F.array().cast("array<string>"))
    above = F.when(F.col("parent_id").isNotNull(), F.array("parent_id")).otherwise(F.array().cast("array<string>"))
    known = settle(nodes.select(*key, F.col("parent_id").alias("__up"), own.alias("__steps"), above.alias("__above")))
    limit, reach = known.groupBy("document_id").count().agg(F.max("count")).first()[0] or 0, 1
    while True:
        waiting = known.filter(F.col("__up").isNotNull())
        if reach > 2 * limit or waiting.isEmpty():
            break
        there = known.select(
            "document_id", F.col("node_id").alias("__up"), F.col("__up").alias("__next"), F.col("__steps").alias("__more"), F.col("__above").alias("__higher")
        )
        moved = waiting.join(there, ["document_id", "__up"]).select(
            *key,
            F.col("__next").alias("__up"),
            F.concat("__more", "__steps").alias("__steps"),
            F.concat("__higher", "__above").alias("__above"),
        )
        known = settle(known.filter(F.col("__up").isNull()).unionByName(moved))
        reach *= 2
    placed = known.filter(F.col("__up").isNull()).select(
        *key, F.array_join("__steps", ".").alias("path"), F.size("__steps").alias("depth"), F.col("__above").alias("ancestors")
    )
    return nodes.drop("path", "depth", "ancestors").join(placed, key)


#: Runs of a query that are intersected.
_PROBES = 3


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    runs = F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))
    return F.when(F.length(text) >= size, runs).otherwise(F.array().cast("array<string>"))


def search_index(nodes: DataFrame) -> DataFrame:
    """``(document_id, gram, node_id)``: the runs of one to three characters in a node's title, summary and keywords."""
    nothing = F.array().cast("array<string>")
    fields = F.concat(F.array("title", "summary"), F.coalesce("keywords", nothing))
    texts = F.transform(fields, lambda x: F.lower(F.coalesce(x, F.lit(""))))
    grams = F.flatten(F.transform(texts, lambda x: F.concat(*[_grams(x, size) for size in (1, 2, 3)])))
    return explode_once(nodes, ["document_id", "node_id"], F.array_distinct(grams), "gram").select("document_id", "gram", "node_id")


def search(nodes: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT, index: DataFrame | None = None) -> DataFrame:
    """First ``limit`` nodes per query in preorder whose title, summary or a keyword contains the text.

    ``queries``: (query_id, document_id, query). A blank query finds nothing. Nodes are looked up in ``index`` (see
    ``search_index``): a query's rarest runs of characters are intersected, and only nodes that hold them all are read.
    """
    index = settle(search_index(nodes)) if index is None else index
    needles = queries.select("query_id", "document_id", F.lower(strip(F.col("query"))).alias("needle")).filter(
        F.col("needle") != ""
    )
    key = ["query_id", "document_id", "needle"]
    size = F.least(F.length("needle"), F.lit(3))
    runs = F.when(size == 1, _grams(F.col("needle"), 1)).when(size == 2, _grams(F.col("needle"), 2)).otherwise(_grams(F.col("needle"), 3))
    asked = explode_once(needles, key, F.array_distinct(runs), "gram").select(*key, "gram")
    # Only runs that are asked for are counted.
    held = index.join(asked.select("document_id", "gram").distinct(), ["document_id", "gram"])
    common = held.groupBy("document_id", "gram").agg(F.count(F.lit(1)).alias("holders"))
    rarest = Window.partitionBy(*key).orderBy("holders", "gram")
    probes = (
        asked.join(common, ["document_id", "gram"], "left")
        .withColumn("__nth", F.row_number().over(rarest))  # a run that no node holds has no count and comes first
        .filter(F.col("__nth") <= _PROBES)
    )
    wanted = probes.groupBy(*key).agg(F.count(F.lit(1)).alias("wanted"))
    candidates = (
        probes.filter(F.col("holders").isNotNull())
        .join(index, ["document_id", "gram"])
        .groupBy(*key, "node_id")
        .agg(F.count(F.lit(1)).alias("found"))
        .join(wanted, key)
        .filter(F.col("found") == F.col("wanted"))
        .select(*key, "node_id")
    )
    order = Window.partitionBy("query_id").orderBy("preorder")
    hit = (
        F.lower("title").contains(F.col("needle"))
        | F.lower("summary").contains(F.col("needle"))
        | F.exists("keywords", lambda k: F.lower(k).contains(F.col("needle")))
    )
    return (
        nodes.join(candidates, ["document_id", "node_id"])
        .filter(hit)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
    )


def map_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    sections = node_sections(links)
    return nodes.join(sections, ["document_id", "node_id"], "left").select(
        "document_id",
        "node_id",
        "path",
        "preorder",
        "title",
        "depth",
        "child_count",
        F.size("keywords").alias("keyword_count"),
        F.coalesce("evidence_sections", F.array().cast(_EMPTY_INTS)).alias("evidence_sections"),
    )


def nodes_without_evidence(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(node_sections(links), ["document_id", "node_id"], "left_anti")


def parent_path(path: Column) -> Column:
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[0-9]+$", "")).otherwise(F.lit(""))


def map_edges(nodes: DataFrame) -> DataFrame:
    """``(source, target)`` paths; ``edge_order`` reads them parent first."""
    return nodes.filter("depth > 0").select(
        "document_id",
        parent_path(F.col("path")).alias("source"),
        F.col("path").alias("target"),
        F.col("preorder").alias("edge_order"),
    )


def map_summary(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("document_id").agg(
        F.count("*").alias("node_count"),
        F.max("depth").alias("max_depth"),
        F.count_if(F.col("depth") == 1).alias("chapter_count"),
        F.count_if(F.size("evidence_sections") == 0).alias("nodes_without_evidence"),
    )


def nested_json(nodes: DataFrame, fields: list[str], *, preorder: str = "preorder", name: str = "tree") -> DataFrame:
    """One nested JSON text per document: each node's ``fields`` plus ``children``.

    Read in preorder, a tree is its nodes' openings with the right number of closings between them, and
    that number follows from the depth of the next node. So nesting needs one look-ahead and one ordered
    concatenation, whatever the depth of the tree.
    """
    shaped = nodes.select(
        "document_id", preorder, "depth", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("__flat")
    )
    ahead = neighbour(shaped, ["document_id"], preorder, F.col("depth"), "__next", following=True)
    closings = F.col("depth") - F.coalesce(F.col("__next"), F.lit(0)) + 1
    opening = F.concat(F.expr("substring(__flat, 1, length(__flat) - 1)"), F.lit(',"children":['))
    closing = F.when(F.col("__next").isNull(), F.repeat(F.lit("]}"), F.col("depth") + 1)).otherwise(
        F.concat(
            F.repeat(F.lit("]}"), F.greatest(closings, F.lit(0))),
            F.when(closings > 0, F.lit(",")).otherwise(F.lit("")),
        )
    )
    parts = ahead.select("document_id", preorder, F.concat(opening, closing).alias("__part"))
    return (
        parts.groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct(preorder, "__part"))).alias("__parts"))
        .select("document_id", F.array_join(F.transform("__parts", lambda p: p["__part"]), "").alias(name))
    )


def map_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The map model of every document as JSON text."""
    mapped = map_nodes(nodes, links)
    fields = ["node_id", "path", "title", "depth", "child_count", "keyword_count", "evidence_sections"]
    tree = nested_json(mapped, fields, name="root")
    edges = (
        map_edges(nodes)
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("edge_order", "source", "target"))).alias("__edges"))
        .select(
            "document_id",
            F.transform("__edges", lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"))).alias(
                "edges"
            ),
        )
    )
    titled = roots(nodes).select("document_id", "title")
    head = (
        titled.join(map_summary(mapped), "document_id")
        .join(edges, "document_id", "left")
        .select(
            "document_id",
            F.to_json(
                F.struct(
                    F.lit(MAP_SCHEMA).alias("schema_version"),
                    "document_id",
                    "title",
                    F.coalesce("edges", F.expr("array()").cast("array<struct<source:string,target:string>>")).alias("edges"),
                    "node_count",
                    "max_depth",
                    "chapter_count",
                    "nodes_without_evidence",
                )
            ).alias("__head"),
        )
    )
    return head.join(tree, "document_id").select(
        "document_id",
        F.concat(
            F.expr("substring(__head, 1, length(__head) - 1)"), F.lit(',"root":'), F.col("root"), F.lit("}")
        ).alias("map_model"),
    )


def tree_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The stored tree of every document as nested JSON."""
    sections = node_sections(links).withColumnRenamed("evidence_sections", "source_section_indexes")
    joined = nodes.join(sections, ["document_id", "node_id"], "left").withColumn(
        "source_section_indexes", F.coalesce("source_section_indexes", F.array().cast(_EMPTY_INTS))
    )
    return nested_json(joined, ["node_id", "title", "summary", "keywords", "source_section_indexes", "depth"])
