"""Repeats of a term travel as its weight, and counts equal those of the full term list."""

from collections import Counter

from pyspark.sql import functions as F

from cartulary.functions.digest import term_occurrences, terms
from cartulary.operators.digest import term_frequency

TEXTS = ["Alpha beta alpha the gamma", "向量检索是指将文本映射为向量 index index 向量检索", "", None, "数据结构与算法分析方法论研究进展综述 data"]


def test_occurrences_equal_the_term_list(spark):
    rows = [(str(i), 0, text) for i, text in enumerate(TEXTS)]
    sections = spark.createDataFrame(rows, "document_id string, section_index int, text string")
    expected = set()
    for row in sections.select("document_id", terms(F.col("text")).alias("t")).collect():
        for term, count in Counter(row["t"] or []).items():
            expected.add((row["document_id"], 0, term, count, row["t"].index(term)))
    assert {tuple(row) for row in term_frequency(sections).collect()} == expected
    alpha = sections.filter("document_id = '0'").select(F.size(term_occurrences(F.col("text")))).first()[0]
    assert alpha == 4
