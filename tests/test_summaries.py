"""Summaries: patterns for Latin texts give what the general ones give, at the cost of a few scans."""

import re
import time

from pyspark.sql import functions as F

from cartulary.functions import digest as D
from cartulary.functions.text import collapse, tidy


def test_latin_sentences_are_cut_as_by_the_general_pattern(spark):
    texts = [
        "First  part; second\tpart here! Third one?no",
        "Ends wide。 then narrow; both！ kinds here?",
        "One sentence\nover two lines without an end",
        "　wide space at the start; narrow one in it;   ",
        ";;!!", "", "short; tiny", "é à ü   ogham space; \x85 next line x",
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = frame.select("text", D.split_sentences(F.col("text")).alias("s"), tidy(F.col("text")).alias("t"), collapse(F.col("text")).alias("c")).collect()
    for row in rows:
        pieces = [" ".join(p.split()) for p in re.findall(D.SENTENCE, row["text"].replace("\n", " "))]
        assert row["s"] == [p for p in pieces if len(p) >= D.SENTENCE_CHARACTERS]
        assert row["t"] == row["c"]


def test_the_sentence_of_frequent_terms_wins_with_and_without_cjk(spark):
    latin = "Nothing of note stands here; engine torque rises when engine load rises; the engine load falls again."
    frame = spark.createDataFrame([(latin,), (latin + "数据协同平台。",)], "text string")
    assert [r["s"] for r in frame.select(D.summarize(F.col("text")).alias("s")).collect()] == ["engine torque rises when engine load rises;"] * 2


def test_a_summary_costs_a_few_scans_of_its_text(spark):
    words = "".join(f"word{i * 37 % 211} " for i in range(600))
    texts = spark.range(3000).select(F.concat(F.lit(words), F.col("id").cast("string")).alias("text")).repartition(4).cache()
    texts.count()

    def seconds(column):
        taken = []
        for _ in range(3):
            started = time.time()
            texts.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - started)
        return min(taken)

    assert seconds(D.summarize(F.col("text"))) < 4 * seconds(D.latin_terms(F.col("text")))
