"""Page-level preparation: versions, noise, markers, contents pages, body size, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.config import DEFAULTS, Settings
from cartulary.functions import headings as H
from cartulary.functions.chunking import split_lines
from cartulary.functions.text import explode_once, strip
from cartulary.operators.ordered import neighbour

PAGE = ["document_id", "page_number"]
CONTENTS_SHARE = 0.5


def best_page_versions(versions: DataFrame) -> DataFrame:
    """``(document_id, page_number, version, text)``: best structure score, the earliest version on ties."""
    scored = versions.withColumn("__score", F.struct(H.page_text_score(F.col("text")), -F.col("version")))
    best = F.max_by(F.struct("version", "text"), F.col("__score"))
    return scored.groupBy(*PAGE).agg(best.alias("b")).select(*PAGE, "b.version", "b.text")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Drop noise, move trailing markers to the next line and split inline items.

    ``lines``: document_id, page_number, line_no, text and optionally size. Adds ``part``.
    """
    base = lines.withColumn("text", strip(F.col("text"))).filter(~H.is_noise_line(F.col("text")))
    marked = base.withColumn("__marker", H.trailing_marker(F.col("text")))
    pending = neighbour(marked, PAGE, "line_no", F.col("__marker"), "__pending")
    body = F.when(F.col("__marker").isNotNull(), H.without_trailing_marker(F.col("text"))).otherwise(F.col("text"))
    moved = pending.withColumn("text", strip(F.concat_ws(" ", "__pending", body)))
    kept = [F.col(c) for c in lines.columns if c != "text"]
    split = explode_once(moved, kept, H.split_inline_items(F.col("text")), "line", "part").withColumnRenamed("line", "text")
    return split.filter(~H.is_noise_line(F.col("text")))


def prepare_pages(
    pages: DataFrame, lines: DataFrame, versions: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """``(pages, lines)`` ready for structure detection.

    A page with less than 12 characters takes its best alternative reading, for the first 50 such pages of a
    document that have one; pages without any text vanish. ``versions`` holds alternative readings.
    """
    trimmed = pages.select(*PAGE, strip(F.coalesce("text", F.lit(""))).alias("text"))
    alternatives = best_page_versions(versions).filter(strip(F.col("text")) != "").select(
        *PAGE, F.col("text").alias("__other")
    )
    thin = trimmed.filter(F.length("text") < settings.replacement_min_text_characters).select(*PAGE)
    order = Window.partitionBy("document_id").orderBy("page_number")
    chosen = (
        thin.join(alternatives, PAGE)
        .withColumn("__n", F.row_number().over(order))
        .filter(F.col("__n") <= settings.replacement_max_pages)
        .drop("__n")
    )
    merged = (
        trimmed.join(chosen, PAGE, "left")
        .select(
            *PAGE, F.coalesce("__other", "text").alias("text"), F.col("__other").isNotNull().alias("from_ocr")
        )
        .filter(F.col("text") != "")
    )
    own = lines.join(merged.filter(~F.col("from_ocr")).select(*PAGE), PAGE, "left_semi").select(
        *PAGE, "line_no", "text", "size", F.lit(False).alias("from_ocr")
    )
    read = explode_once(
        merged.filter("from_ocr"), PAGE, split_lines(F.col("text")), "line", "line_no"
    ).select(
        *PAGE,
        "line_no",
        F.col("line").alias("text"),
        F.lit(None).cast("double").alias("size"),
        F.lit(True).alias("from_ocr"),
    )
    every = own.unionByName(read.withColumn("line_no", F.col("line_no").cast(dict(own.dtypes)["line_no"])))
    return merged, clean_lines(every)


def contents_pages(lines: DataFrame, level: Column | None = None) -> DataFrame:
    """Pages with at least three lines of three characters, half of them contents entries.

    ``level`` is the lines' numbering level where it is known already.
    """
    long_enough = lines.filter(F.length(strip(F.col("text"))) >= 3)
    return (
        long_enough.groupBy(*PAGE)
        .agg(
            F.count("*").alias("line_count"),
            F.count_if(H.looks_like_contents_entry(F.col("text"), level)).alias("entry_count"),
        )
        .filter((F.col("line_count") >= 3) & (F.col("entry_count") / F.col("line_count") >= CONTENTS_SHARE))
    )


def body_sizes(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Most frequent font size per document, rounded to 0.1; the size seen first wins a tie."""
    position = F.struct("page_number", order)
    counted = (
        lines.filter(F.col("size") > 0)
        .groupBy("document_id", F.bround("size", 1).alias("body_size"))
        .agg(F.count("*").alias("n"), F.min(position).alias("first"))
    )
    # Sizes are few per document after this aggregation.
    best = F.min_by("body_size", F.struct((-F.col("n")).alias("n"), F.col("first")))
    return counted.groupBy("document_id").agg(best.alias("body_size"))


def chapter_openers(lines: DataFrame, order: str, level: Column | None = None) -> DataFrame:
    """``(document_id, page_number, opener)``: a short line before numbered sections near the page's top.

    Eight candidates and six lines after each can matter, so only the first lines of a page are windowed, and only
    candidates keep their text.
    """
    top = Window.partitionBy(*PAGE).orderBy(order)
    level = H.heading_level(F.col("text")) if level is None else level
    numbered = F.when(H.is_numbered_section(F.col("text")), 1).otherwise(0)
    brief = lines.select(
        *PAGE, order, F.when(H.could_open_chapter(F.col("text"), level), F.col("text")).alias("text"), numbered.alias("__numbered")
    )
    head = brief.withColumn("__n", F.row_number().over(top)).filter(F.col("__n") <= 15)
    seen = head.withColumn("__next", F.lead("__numbered").over(top)).withColumn(
        "__ahead", F.sum("__numbered").over(top.rowsBetween(1, 6))
    )
    fit = (F.col("__n") <= 8) & (F.col("__next") == 1) & (F.col("__ahead") >= 2) & F.col("text").isNotNull()
    return seen.filter(fit).groupBy(*PAGE).agg(F.min_by("text", "__n").alias("opener"))


def page_sections(pages: DataFrame) -> DataFrame:
    """One section per page with text."""
    return pages.filter(strip(F.col("text")) != "").select(
        "document_id",
        F.col("page_number").cast("long").alias("order"),
        F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("title"),
        F.lit(1).alias("level"),
        "text",
        F.col("page_number").cast("int").alias("page_number"),
    )


def text_coverage(pages: DataFrame) -> DataFrame:
    """Pages, characters, images and characters per page of every document.

    ``pages``: document_id, page_number, text, image_count.
    """
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.sum(F.length(strip(F.col("text")))).alias("characters"),
        F.sum("image_count").alias("images"),
        F.round(F.avg(F.length(strip(F.col("text")))), 1).alias("characters_per_page"),
        F.count_if(F.col("image_count") > 0).alias("image_pages"),
    )


def version_report(versions: DataFrame) -> DataFrame:
    """Per page and reading: CJK characters, heading-like lines and the bracketed numerals that occur."""
    lines = F.transform(split_lines(F.col("text")), lambda line: strip(line))
    return versions.select(
        *PAGE,
        "version",
        F.regexp_count("text", F.lit("[\\u4e00-\\u9fff]")).alias("cjk"),
        F.size(F.filter(lines, lambda line: line.rlike(f"(?U){H.HEADING_HINT}"))).alias("heading_like"),
        H.found_markers(F.col("text")).alias("markers"),
    )
