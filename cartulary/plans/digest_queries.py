"""Content test, sentences, terms, keywords and best sentences of the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions.digest import has_content, split_sentences
from cartulary.functions.text import collapsed_start, explode_once, location_label, quote_excerpt, shorten
from cartulary.operators.digest import document_frequency, keywords, summaries, term_frequency
from cartulary.plans.catalogue import query
from cartulary.plans.inputs import (
    SQL_DOCUMENT_SECTIONS,
    SQL_SOURCE_SECTIONS,
    document_sections,
    source_sections,
)
from cartulary.plans.sql_digest import (
    sql_best_sentences,
    sql_collapse,
    sql_keywords,
    sql_sentences,
    sql_shorten,
    sql_terms,
)
from cartulary.sources.tables import read_table

@query(
    "has_content",
    """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]+')) >= 3 AS has_content FROM documents""",
)
def has_content_query(spark, folder):
    table = read_table(spark, folder, "documents", heavy=True)
    return table.select("doc_id", has_content(F.col("text")).alias("has_content"))


@query(
    "sentences",
    f"""WITH pieces AS (SELECT doc_id, {sql_sentences("text")} AS s FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, s[i] AS sentence
FROM pieces, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)""",
)
def sentences_query(spark, folder):
    table = read_table(spark, folder, "documents", heavy=True)
    return explode_once(table, ["doc_id"], split_sentences(F.col("text")), "sentence", "position")


@query(
    "term_df",
    f"""SELECT source AS document_id, term, count(*) AS df
FROM (SELECT source, unnest(list_distinct({sql_terms("text")})) AS term FROM documents) GROUP BY ALL""",
)
def term_df(spark, folder):
    return document_frequency(source_sections(spark, folder))


@query(
    "term_tf",
    f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, term, 3 * count(*) AS tf, CAST(3 * min(i - 1) AS INTEGER) AS first_position
FROM (SELECT doc_id, t[i] AS term, i FROM (SELECT doc_id, {sql_terms("text")} AS t FROM documents),
      LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)) GROUP BY ALL""",
)
def term_tf(spark, folder):
    return term_frequency(document_sections(spark, folder)).drop("section_index")


@query(
    "section_keywords",
    f"""WITH RECURSIVE {SQL_SOURCE_SECTIONS},
sources AS (
  SELECT document_id, section_index, substring({sql_collapse("text")}, 1, 600) AS text FROM source_sections),
{sql_keywords("source_sections", "sources")}
SELECT * FROM picked""",
)
def section_keywords(spark, folder):
    """Keywords of every text against the term statistics of its source."""
    sections = source_sections(spark, folder)
    sources = sections.select(
        "document_id", "section_index", collapsed_start(F.col("text"), 600).alias("keyword_source")
    )
    found = keywords(sources, document_frequency(sections))
    return found.withColumn("keywords", F.array_join("keywords", "|"))


@query(
    "best_sentence",
    f"""WITH {SQL_DOCUMENT_SECTIONS}, {sql_best_sentences("doc_sections", "document_id")}
SELECT document_id, 0 AS section_index, summary FROM digest""",
)
def best_sentence(spark, folder):
    return summaries(document_sections(spark, folder))


@query(
    "text_excerpts",
    f"""SELECT doc_id, substring({sql_collapse("text")}, 1, 240) AS quote,
  CASE WHEN quality IS NULL THEN 'source' WHEN quality = 1 THEN 'p.' || doc_id ELSE '¶' || (doc_id + 1) END AS location
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def text_excerpts(spark, folder):
    """Quotes and location labels; the label table decides which kind of location a text has."""
    joined = read_table(spark, folder, "documents", heavy=True).join(
        read_table(spark, folder, "labels"), "doc_id", "left"
    )
    page = F.when(F.col("quality") == 1, F.col("doc_id"))
    paragraph = F.when(F.col("quality") == 0, F.col("doc_id"))
    return joined.select(
        "doc_id", quote_excerpt(F.col("text")).alias("quote"), location_label(page, paragraph).alias("location")
    )


@query(
    "shortened_titles",
    f"""SELECT page_id, {sql_shorten("c", 30)} AS title
FROM (SELECT page_id, {sql_collapse("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS c FROM pages)""",
)
def shortened_titles(spark, folder):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return read_table(spark, folder, "pages", heavy=True).select("page_id", shorten(title, 30).alias("title"))
