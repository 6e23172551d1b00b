"""Heading, label and numbering rules on single lines."""

import pytest
from pyspark.sql import functions as F

from cartulary.functions import headings as H


def apply(spark, texts, column):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["x"] for r in frame.select("i", column(F.col("text")).alias("x")).orderBy("i").collect()]


def test_heading_levels(spark):
    cases = {
        "第一章 总论": 1,
        "第一章　总论": 1,
        "第一章总论": None,
        "第 2 篇 方法": 1,
        "第三节 数据": 2,
        "一、研究背景": 2,
        "（一）技术路径": 3,
        "(=) 数据路径": 3,
        "（12）长效运营": 4,
        "1.1 背景": 3,
        "1. 优化流程": 4,
        "1.5 亿元": 3,
        "1、2019年": None,
        "Chapter 3 Results": 1,
        "一、这是一句话。": None,
        "一、这是半句，": None,
        "(1) 列表项目;": 4,
        "普通正文": None,
        "": None,
        "一、" + "长" * 90: None,
    }
    assert dict(zip(cases, apply(spark, list(cases), H.heading_level))) == cases


def test_visual_level_needs_size_and_body(spark):
    rows = [("Big", 20.0, 12.0), ("Mid", 16.0, 12.0), ("Small", 14.0, 12.0), ("Body", 12.0, 12.0), ("End.", 20.0, 12.0), ("None", None, 12.0), ("NoBody", 20.0, None)]
    frame = spark.createDataFrame(rows, "text string, size double, body double")
    got = {r["text"]: r["x"] for r in frame.select("text", H.visual_level(F.col("text"), F.col("size"), F.col("body")).alias("x")).collect()}
    assert got == {"Big": 1, "Mid": 2, "Small": 3, "Body": None, "End.": None, "None": None, "NoBody": None}


def test_noise_and_contents(spark):
    assert apply(spark, ["", " - 12 - ", "……", "..... ", "第1页", "2024 年"], H.is_noise_line) == [True, True, True, True, False, False]
    assert apply(spark, ["第二章 方法 …… 12", "第二章 方法 12", "普通 12", "ab"], H.looks_like_contents_entry) == [True, True, False, False]


def test_labels(spark):
    got = apply(spark, ["传统发展痛点: (1) 甲", "典型案例：某厂建成平台，效果好", "其他标签: 甲"], H.split_label)
    assert [tuple(x) if x else None for x in got] == [("传统发展痛点", "(1) 甲"), ("典型案例", "某厂建成平台，效果好"), None]
    noise = apply(spark, ["RRR RB: (1) 知识传承: 甲", "备注: 普通说明", "说明: 1 项", "赋能路径: (1) 甲"], H.split_noise_label)
    assert [tuple(x) if x else None for x in noise] == [("RRR RB", "(1) 知识传承: 甲"), None, ("说明", "1 项"), None]
    titled = spark.createDataFrame([("典型案例", "某厂建成平台，效果好"), ("典型案例", ""), ("赋能路径", "x，y")], "l string, b string")
    assert [r["x"] for r in titled.select(H.label_title(F.col("l"), F.col("b")).alias("x")).collect()] == ["典型案例：某厂建成平台", "典型案例", "赋能路径"]


def test_items_and_markers(spark):
    assert apply(spark, ["痛点: (1) 甲; (2 ) 乙"], H.split_inline_items) == [["痛点:", "(1) 甲;", "(2 ) 乙"]]
    got = apply(spark, ["(3) 系统匹配: 适配不足", "(3) 没有标签的一行", "plain"], H.numbered_item)
    assert [tuple(x) for x in got] == [("(3) 系统匹配", "适配不足"), ("(3) 没有标签的一行", "(3) 没有标签的一行"), ("plain", "plain")]
    assert apply(spark, ["促进沉淀; ( 2 )", "无"], H.trailing_marker) == ["(2)", None]


def test_numerals_and_chapter_numbers(spark):
    assert apply(spark, ["五", "十", "二十", "二十三", "百", "两", ""], H.chinese_to_int) == [5, 10, 20, 23, None, None, None]
    numbers = spark.createDataFrame([(n,) for n in (1, 10, 12, 20, 35)], "n int")
    assert [r["x"] for r in numbers.select(H.int_to_chinese(F.col("n")).alias("x")).collect()] == ["一", "十", "十二", "二十", "三十五"]
    assert apply(spark, ["第五章 建设", "第 三 章", "五、建设"], H.chapter_number) == [5, 3, None]


def test_teens_have_a_ten(spark):
    assert apply(spark, ["十一", "十二", "十九", "九十八"], H.chinese_to_int) == [11, 12, 19, 98]


def test_normalising(spark):
    assert apply(spark, ["(=) 数据  路径", "（I）甲", "（二）甲"], H.normalize_heading) == ["(二) 数据 路径", "（一）甲", "（二）甲"]
    assert apply(spark, ["第一章 总论 …… 3", "第一章  总论"], H.dedupe_key) == ["第一章总论", "第一章总论"]
    assert apply(spark, ["AB 智能制造", "12 智能制造", "智能"], H.strip_opener_noise) == ["智能制造", "智能制造", "智能"]


def test_title_rule(spark):
    assert apply(spark, ["数字化转型研究", "摘要", "Abstract of work", "一、背景", "一句话。", "12"], H.looks_like_document_title) == [True, False, False, False, False, False]


def test_paragraph_level(spark):
    rows = [
        ("一、背景", "Title", None, 2),
        ("Method", "Heading 2", None, 2),
        ("方法", "标题 3", None, 3),
        ("Paper", "Title", None, 1),
        ("Outline", "Normal", 0, 1),
        ("Outline", "Normal", 9, None),
        ("A sentence。", "Heading 1", None, None),
    ]
    frame = spark.createDataFrame(rows, "text string, style string, outline int, want int")
    for row in frame.withColumn("got", H.paragraph_level(F.col("text"), F.col("style"), F.col("outline"))).collect():
        assert row["got"] == row["want"], row


@pytest.mark.parametrize("pair", [("第一章 总论", "第一章"), ("（ 二 ）甲", "（二）"), ("3 、甲", "3、"), ("甲", "")])
def test_numbering_prefix(spark, pair):
    assert apply(spark, [pair[0]], H.numbering_prefix) == [pair[1]]
