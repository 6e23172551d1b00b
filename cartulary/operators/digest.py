"""Term statistics, keywords and summaries of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.digest import (
    KEYWORDS,
    contenders,
    distinct_terms,
    length_penalty,
    select_keywords,
    summarize,
    term_occurrences,
    term_totals,
)
from cartulary.functions.text import explode_once


def document_frequency(sections: DataFrame, text: str = "text") -> DataFrame:
    """``(document_id, term, df)``: a section counts each of its terms once."""
    return (
        explode_once(sections, ["document_id"], distinct_terms(F.col(text)), "term")
        .groupBy("document_id", "term")
        .agg(F.count("*").alias("df"))
    )


def term_frequency(sections: DataFrame, text: str = "text") -> DataFrame:
    """``(document_id, section_index, term, tf, first_position)``; repeats travel as weights."""
    key = ["document_id", "section_index"]
    return (
        explode_once(sections, key, term_occurrences(F.col(text)), "found")
        .groupBy(*key, F.col("found.term").alias("term"))
        .agg(F.sum("found.weight").alias("tf"), F.min("found.at").alias("first_position"))
    )


def keywords(
    sources: DataFrame, frequency: DataFrame | None, text: str = "keyword_source", limit: int = KEYWORDS
) -> DataFrame:
    """``(document_id, section_index, keywords)`` ranked by count, document frequency and shape.

    Keyword sources are short by construction: the texts of a section come together before they are cut into terms,
    and only terms that can be chosen meet their document frequency.
    """
    key = ["document_id", "section_index"]
    texts = sources.groupBy(*key).agg(F.collect_list(text).alias("__texts"))
    totals = term_totals(F.flatten(F.transform("__texts", term_occurrences)))
    found = explode_once(texts, key, contenders(totals, limit), "found").select(*key, "found.*")
    if frequency is None:
        weighted = found.withColumn("df", F.lit(0).cast("bigint"))
    else:
        weighted = found.join(frequency, ["document_id", "term"], "left")
    order = F.struct(
        (-F.col("tf")).alias("by_count"),
        (-F.coalesce("df", F.lit(0))).alias("by_frequency"),
        length_penalty(F.col("term")).alias("by_penalty"),
        (-F.length("term")).alias("by_length"),
        F.col("at").alias("by_position"),
        F.col("term").alias("term"),
    )
    ranked = weighted.groupBy(*key).agg(F.sort_array(F.collect_list(order)).alias("ranked"))
    return ranked.select(*key, select_keywords(F.transform("ranked", lambda x: x["term"]), limit).alias("keywords"))


def summaries(sections: DataFrame, text: str = "text") -> DataFrame:
    return sections.select("document_id", "section_index", summarize(F.col(text)).alias("summary"))
