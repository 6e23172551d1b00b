"""Digest rules on hand-made Chinese and Latin texts; expectations follow from the published rules."""

from pyspark.sql import functions as F

from cartulary.functions import digest as D
from cartulary.functions.text import shorten, strip
from cartulary.operators.digest import document_frequency, keywords


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_has_content_counts_cjk_or_words(spark):
    rows = [("12", False), ("数据", False), ("数据 协同", True), ("one two three", True), ("a b c", False), ("ab cd", False)]
    frame = spark.createDataFrame(rows, "text string, want boolean")
    assert [r["got"] for r in frame.select(D.has_content(F.col("text")).alias("got")).collect()] == [w for _, w in rows]


def test_sentences_keep_terminators_and_drop_short_ones(spark):
    assert one(spark, "短。这是一个比较长的句子。\nSecond sentence here! ok", D.split_sentences) == [
        "这是一个比较长的句子。",
        "Second sentence here!",
    ]


def test_terms_weight_spans_and_expand_long_runs(spark):
    found = one(spark, "Data data of 数据协同", D.terms)
    assert found == ["data"] * 6 + ["数据协同"] * 3
    long_run = one(spark, "数据金融服务平台建设", D.terms)
    assert long_run[0] == "数据" and "数据金融服" in long_run and len(long_run) == 9 + 8 + 7 + 6
    # An n-gram inside a bounded span of the same text is not a term of its own.
    mixed = one(spark, "数据协同，数据协同平台服务能力建设", D.terms)
    assert mixed[:3] == ["数据协同"] * 3 and "数据" not in mixed and "平台" in mixed


def test_very_long_runs_only_give_bigrams(spark):
    assert {len(t) for t in one(spark, "甲乙丙丁戊己庚辛壬癸" * 5, D.terms)} == {2}


def test_summary_prefers_definitions_and_strips_glued_fragment(spark):
    text = "合 平台建设持续推进。数字平台是指支撑平台建设的数字系统。其他内容暂不讨论。"
    assert one(spark, text, D.summarize) == "数字平台是指支撑平台建设的数字系统。"
    assert one(spark, "短句", D.summarize) == "短句"


def test_shorten_cuts_at_a_separator_in_the_second_half(spark):
    assert one(spark, "一二三四五六，七八九十", lambda c: shorten(c, 8)) == "一二三四五六"
    assert one(spark, "一，二三四五六七八九十", lambda c: shorten(c, 8)) == "一，二三四五六七"


def test_strip_knows_unicode_spaces(spark):
    assert one(spark, "　 a b \x1f\n", strip) == "a b"


def test_keywords_rank_by_count_then_frequency_and_skip_contained(spark):
    rows = [("d", 0, "系统平台 系统平台 平台"), ("d", 1, "平台 服务")]
    sections = spark.createDataFrame(rows, "document_id string, section_index int, text string")
    sources = sections.withColumn("keyword_source", F.col("text"))
    found = {r["section_index"]: r["keywords"] for r in keywords(sources, document_frequency(sections)).collect()}
    assert found == {0: ["系统平台"], 1: ["平台", "服务"]}
