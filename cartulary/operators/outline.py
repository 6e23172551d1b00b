"""Sections with levels to an outline tree, as adjacency rows.

``sections``: document_id, section_index (unique per document, in reading order), title, level, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.digest import KEYWORD_SOURCE_CHARACTERS, has_content, summarize
from cartulary.functions.ids import node_id
from cartulary.functions.text import collapse, strip
from cartulary.operators.digest import document_frequency, keywords
from cartulary.operators.ordered import Carry, composed, running
from cartulary.session import settle

TITLE_CHARACTERS = 160
KEY = ["document_id", "section_index"]


_STACK = "array<struct<level:int,at:int>>"


def _onto(first: Column, then: Column) -> Column:
    """Sections of ``first`` that ``then`` leaves in sight, and those of ``then``; a section hides all of its level or deeper.

    The sections in sight after some rows are in order and of rising levels, so what more rows do to them depends on the
    smallest level of these alone, which stands first. That makes the stack of an outline an associative composition.
    """
    seen = F.filter(first, lambda x: x["level"] < F.get(then, F.lit(0))["level"])
    return F.when(F.size(then) == 0, first).otherwise(F.concat(seen, then))


def _in_sight(sections: DataFrame, reverse: bool) -> DataFrame:
    """Sections with ``__stack``: the earlier (later, if ``reverse``) ones in sight, the nearest last."""
    leveled = sections.withColumn("level", F.greatest(F.lit(1), F.col("level")).cast("int"))
    own = F.array(F.struct(F.col("level"), F.col("section_index").cast("int").alias("at"))).cast(_STACK)
    return composed(leveled, ["document_id"], "section_index", own, "__stack", _onto, F.array().cast(_STACK), reverse=reverse)


def outline_parents(sections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``parent_index`` and ``ancestors`` (section indexes, root first).

    The parent is the nearest earlier section of a smaller level, and the ancestors are all sections in sight that have
    smaller levels. Levels may be of any size and number; the plan is the same.
    """
    above = F.filter("__stack", lambda x: x["level"] < F.col("level"))
    scanned = _in_sight(sections, False).withColumn("ancestors", F.transform(above, lambda x: x["at"]))
    kept = [F.col(c) for c in sections.columns if c != "level"]
    return scanned.select(*kept, "level", F.get("ancestors", F.size("ancestors") - 1).alias("parent_index"), "ancestors")


def subtree_ends(sections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``subtree_end``: index of the first later section that is not below this one, null at the end."""
    outside = F.filter("__stack", lambda x: x["level"] <= F.col("level"))
    scanned = _in_sight(sections, True).withColumn("__outside", outside)
    kept = [F.col(c) for c in sections.columns if c != "level"]
    return scanned.select(*kept, "level", F.get("__outside", F.size("__outside") - 1)["at"].alias("subtree_end"))


def _too_wide(outlined: DataFrame, settings: Settings) -> DataFrame:
    return (
        outlined.filter(F.col("parent_index").isNull())
        .groupBy("document_id")
        .agg(F.count("*").alias("top_level_sections"))
        .filter(F.col("top_level_sections") > settings.max_node_children)
    )


def tree_failures(sections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents whose outline has more top-level sections than a node may have children."""
    return _too_wide(outline_parents(sections.select("document_id", "section_index", "level"), settings), settings)


def tree_status(titles: DataFrame, sections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per document: ``ready`` with the number of kept sections, or ``failed`` with a code where it is too wide."""
    wide = tree_failures(sections, settings)
    kept = place_sections(sections, settings).groupBy("document_id").agg(F.count(F.lit(1)).alias("kept_sections"))
    failed = F.col("top_level_sections").isNotNull()
    return titles.select("document_id").join(wide, "document_id", "left").join(kept, "document_id", "left").select(
        "document_id",
        F.when(failed, "failed").otherwise("ready").alias("status"),
        F.coalesce("kept_sections", F.lit(0)).alias("kept_sections"),
        F.when(failed, "too_many_children").alias("error_code"),
        F.when(failed, F.concat(F.col("top_level_sections").cast("string"), F.lit(" top-level sections"))).alias("error_message"),
    )


def _positions(outlined: DataFrame) -> DataFrame:
    """``position`` of every section among its parent's children, however many there are, in blocks of sections."""
    keyed = outlined.withColumn("__under", F.coalesce("parent_index", F.lit(-1)))
    ranked = running(keyed, ["document_id", "__under"], "section_index", [Carry("position", F.lit(1), "sum")])
    return ranked.drop("__under").withColumn("position", F.col("position").cast("int"))


def _first_positions(outlined: DataFrame, settings: Settings) -> DataFrame:
    """``position`` of the first children of every node; documents that are too wide for a stored tree have none."""
    siblings = Window.partitionBy("document_id", "parent_index").orderBy("section_index")
    # A ranked filter is limited before the shuffle, so a parent with very many children costs 64 rows a task.
    return (
        outlined.withColumn("__rank", F.row_number().over(siblings))
        .filter(F.col("__rank") <= settings.max_node_children)
        .withColumn("position", (F.col("__rank") - 1).cast("int"))
        .join(_too_wide(outlined, settings).select("document_id"), "document_id", "left_anti")
    )


def place_sections(sections: DataFrame, settings: Settings = DEFAULTS, *, whole: bool = False) -> DataFrame:
    """Add position, path and depth; sections beyond the child cap, and all below them, are dropped.

    With ``whole`` there is no cap: every section of every document has its place. Works on the keys only; text columns
    should be joined afterwards.
    """
    outlined = settle(outline_parents(sections.select("document_id", "section_index", "level"), settings))
    placed = _positions(outlined) if whole else _first_positions(outlined, settings)
    # Each section fetches the positions of its ancestors; a missing one means that the section is cut off.
    chain = outlined.select(*KEY, F.explode("ancestors").alias("ancestor"))
    positions = placed.select("document_id", F.col("section_index").alias("ancestor"), F.col("position").alias("at"))
    steps = (
        chain.join(positions, ["document_id", "ancestor"])
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("ancestor", "at"))).alias("steps"))
    )
    joined = placed.join(steps, KEY, "left").filter(F.size("ancestors") == F.coalesce(F.size("steps"), F.lit(0)))
    parts = F.concat(
        F.coalesce(F.transform("steps", lambda s: s["at"].cast("string")), F.array().cast("array<string>")),
        F.array(F.col("position").cast("string")),
    )
    return joined.select(
        *KEY,
        "level",
        "parent_index",
        "ancestors",
        "position",
        F.array_join(parts, ".").alias("path"),
        (F.size("ancestors") + 1).alias("depth"),
    )


def covered_sections(placed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(document_id, section_index, section_indexes)``: own index and descendants in preorder, the first 24.

    Every section reports to each of its ancestors, unless it comes too late to be among the first.
    """
    ranked = running(
        placed.select(*KEY, "ancestors"), ["document_id"], "section_index", [Carry("rank", F.lit(1), "sum")]
    )
    reports = ranked.select(
        "document_id",
        F.col("section_index").alias("member"),
        F.col("rank").alias("member_rank"),
        F.explode(F.array_append("ancestors", F.col("section_index").cast("int"))).alias("section_index"),
    )
    return (
        reports.join(ranked.select(*KEY, "rank"), KEY)
        .filter(F.col("member_rank") - F.col("rank") < settings.max_evidence_sections)
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list("member")).alias("section_indexes"))
    )


def _no_digest() -> list[Column]:
    return [F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<string>").alias("keywords")]


def _digested(joined: DataFrame, frequency: DataFrame) -> DataFrame:
    """Add summary and keywords; a section without content borrows from those below it."""
    borrowed = F.substring(
        F.array_join(F.transform("__below", lambda c: c["__source"]), " "), 1, KEYWORD_SOURCE_CHARACTERS
    )
    source = (
        F.when(F.col("__rich") & (F.col("__source") != ""), F.col("__source"))
        .when((F.col("child_count") > 0) & (borrowed != ""), borrowed)
        .otherwise(F.col("title"))
    )
    words = keywords(joined.select(*KEY, source.alias("keyword_source")), frequency)
    summary = F.coalesce(
        F.when(F.col("__digest") != "", F.col("__digest")),
        F.when(
            F.col("child_count") > 0,
            F.concat(F.lit("该章节下含 "), F.col("child_count").cast("string"), F.lit(" 个小节，内容见子节点。")),
        ),
        F.col("title"),
    )
    return joined.join(words, KEY, "left").withColumns(
        {"summary": summary, "keywords": F.coalesce("keywords", F.array().cast("array<string>"))}
    )


def build_tree(
    sections: DataFrame, titles: DataFrame, settings: Settings = DEFAULTS, *, digests: bool = True, whole: bool = False
) -> DataFrame:
    """Outline nodes of every document: one root plus one node per kept section, per section if ``whole``.

    ``titles``: (document_id, title). Summaries and keywords are extractive. Without ``digests`` both are null and no
    text is read, for readers of the outline alone.
    """
    placed = settle(place_sections(sections, settings, whole=whole))
    covered = covered_sections(placed, settings)
    # Each text is collapsed and tested once: a projection whose costly columns are read more than once is not merged.
    read = sections.select(
        *KEY,
        strip(F.col("title")).alias("__title"),
        has_content(F.col("text")).alias("__rich"),
        collapse(F.coalesce("text", F.lit(""))).alias("__body"),
    )
    texts = read.select(
        *KEY,
        F.when(F.col("__title") != "", F.substring("__title", 1, TITLE_CHARACTERS))
        .otherwise(F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string")))
        .alias("title"),
        "__rich",
        F.when(F.col("__rich"), summarize(F.col("__body"))).alias("__digest"),
        F.substring("__body", 1, KEYWORD_SOURCE_CHARACTERS).alias("__source"),
    )
    nodes = settle(placed.join(texts if digests else texts.select(*KEY, "title"), KEY))
    # Each source adds a space at least, so the characters that are borrowed lie in these.
    lent = F.when(F.col("position") <= KEYWORD_SOURCE_CHARACTERS, F.struct("position", "__source"))
    below = (
        nodes.filter(F.col("parent_index").isNotNull())
        .groupBy("document_id", F.col("parent_index").alias("section_index"))
        .agg(
            F.count("*").cast("int").alias("child_count"),
            *([F.sort_array(F.collect_list(lent)).alias("__below")] if digests else []),
        )
    )
    joined = nodes.join(below, KEY, "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    told = _digested(joined, document_frequency(sections)) if digests else joined.select("*", *_no_digest())
    own = node_id(F.col("document_id"), F.col("path"))
    parent = node_id(
        F.col("document_id"), F.when(F.col("path").contains("."), F.regexp_replace("path", r"\.[0-9]+$", "")).otherwise("")
    )
    branches = (
        told.join(covered, KEY)
        .select(
            "document_id",
            own.alias("node_id"),
            parent.alias("parent_id"),
            "path",
            "depth",
            "position",
            (F.col("section_index") + 1).cast("int").alias("preorder"),
            "title",
            "summary",
            "keywords",
            "section_indexes",
            "child_count",
        )
    )
    tops = branches.filter("depth = 1").groupBy("document_id").agg(F.count("*").cast("int").alias("child_count"))
    roots = tops.join(titles, "document_id").select(
        "document_id",
        node_id(F.col("document_id"), F.lit("")).alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("").alias("path"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("position"),
        F.lit(0).alias("preorder"),
        F.substring("title", 1, TITLE_CHARACTERS).alias("title"),
        *([F.col("title").alias("summary"), F.array().cast("array<string>").alias("keywords")] if digests else _no_digest()),
        F.array().cast("array<int>").alias("section_indexes"),
        "child_count",
    )
    return roots.unionByName(branches)


def describe_tree(nodes: DataFrame, mode: str = "structure_fallback", limit: int = 12) -> DataFrame:
    """Node count with the root, deepest level and the first distinct leaf titles in preorder."""
    totals = nodes.groupBy("document_id").agg(F.count("*").alias("node_count"), F.max("depth").alias("max_depth"))
    first = Window.partitionBy("document_id").orderBy("preorder", "title")
    leaves = (
        nodes.filter((F.col("child_count") == 0) & (F.col("depth") > 0))
        .groupBy("document_id", "title")
        .agg(F.min("preorder").alias("preorder"))
        .withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") <= limit)
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("__rank", "title"))).alias("__leaves"))
    )
    return totals.join(leaves, "document_id", "left").select(
        "document_id",
        F.lit(mode).alias("mode"),
        "node_count",
        "max_depth",
        F.coalesce(F.transform("__leaves", lambda x: x["title"]), F.array().cast("array<string>")).alias("labels"),
    )


def document_digest(sections: DataFrame, documents: DataFrame, chunk_counts: DataFrame, limit: int = 25) -> DataFrame:
    """Section and chunk counts, an indented outline of the first sections, and warnings.

    ``documents``: document_id, title, structure_source, ocr_page_count.
    """
    filled = sections.filter(strip(F.col("text")) != "")
    counts = filled.groupBy("document_id").agg(F.count("*").alias("section_count"))
    first = Window.partitionBy("document_id").orderBy("section_index")
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), F.col("title"))
    outline = (
        filled.select("document_id", "section_index", line.alias("line"))
        .withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") <= limit)
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("__rank", "line"))).alias("__lines"))
    )
    pages = F.coalesce(F.col("ocr_page_count"), F.lit(0))
    # The three warnings.
    warnings = F.array_compact(
        F.array(
            F.when(F.col("section_count") == 0, F.lit("解析后没有任何可用文本")),
            F.when(F.col("structure_source") == "pages", F.lit("未能识别章节结构，已退回按页分节")),
            F.when(pages > 0, F.concat(pages.cast("string"), F.lit(" 页通过 OCR 识别，可能含识别噪声"))),
        )
    )
    joined = (
        documents.join(counts, "document_id", "left")
        .join(chunk_counts, "document_id", "left")
        .join(outline, "document_id", "left")
        .withColumn("section_count", F.coalesce("section_count", F.lit(0)))
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    )
    return joined.select(
        "document_id",
        "title",
        "structure_source",
        "section_count",
        "chunk_count",
        F.coalesce(F.transform("__lines", lambda x: x["line"]), F.array().cast("array<string>")).alias("outline"),
        warnings.alias("warnings"),
    )

