"""Keywords are chosen from the terms that can be reached, and equal a choice from all of them."""

import random

from pyspark.sql import functions as F

from cartulary.functions.digest import contenders, terms, term_occurrences, term_totals
from cartulary.functions.text import collapse, collapsed_start
from cartulary.operators.digest import document_frequency, keywords

SYLLABLES = ("ba", "net", "work", "er", "lo", "graph", "mi", "数据", "网络模型", "的")


def _texts(n: int) -> list[str]:
    draw = random.Random(7)
    words = ["".join(draw.choices(SYLLABLES[:7], k=draw.randint(1, 3))) for _ in range(30)]
    return [
        " ".join(draw.choice(words) if draw.random() < 0.9 else draw.choice(SYLLABLES) for _ in range(draw.randint(0, 60)))
        for _ in range(n)
    ]


def _plain(rows: list[tuple], frequency: dict, lists: dict, limit: int = 5) -> dict:
    """Every term of a section ranked, none left out."""
    chosen = {}
    found: dict = {}
    for (document, section, _), words in zip(rows, lists, strict=True):
        for at, word in enumerate(words):
            tf, first = found.setdefault((document, section), {}).get(word, (0, at))
            found[document, section][word] = (tf + 1, min(first, at))
    for key, counted in found.items():
        def rank(word, key=key, counted=counted):
            shape = 0 if word[0] < "一" else max(0, len(word) - 4)
            return -counted[word][0], -frequency.get((key[0], word), 0), shape, -len(word), counted[word][1], word

        picked: list[str] = []
        for word in sorted(counted, key=rank):
            if len(picked) < limit and not any(word in c or c in word for c in picked):
                picked.append(word)
        chosen[key] = picked
    return chosen


def test_keywords_equal_a_choice_from_all_terms_also_for_a_repeated_section(spark):
    rows = [(f"d{i % 3}", i // 2, text) for i, text in enumerate(_texts(120))] + [("d0", 0, "lone word"), ("d9", 1, None), ("d9", 2, "")]
    frame = spark.createDataFrame(rows, "document_id string, section_index int, text string").coalesce(1)
    frequency = document_frequency(frame)
    known = {(r["document_id"], r["term"]): r["df"] for r in frequency.collect()}
    lists = [r["t"] or [] for r in frame.select(terms(F.col("text")).alias("t")).collect()]
    found = {(r["document_id"], r["section_index"]): r["keywords"] for r in keywords(frame, frequency, "text").collect()}
    assert found == _plain(rows, known, lists)
    alone = {(r["document_id"], r["section_index"]): r["keywords"] for r in keywords(frame, None, "text").collect()}
    assert alone == _plain(rows, {}, lists)


def test_terms_out_of_reach_do_not_travel(spark):
    often = "apple banana cherry damson elder " * 2
    rows = [(0, often + "fig grape hazel"), (1, "apple banana cherry fig"), (2, "apple apple pineapple pineapple banana")]
    frame = spark.createDataFrame(rows, "id int, text string")
    kept = contenders(term_totals(term_occurrences(F.col("text"))), 5)
    found = {r["id"]: sorted(r["t"]) for r in frame.select("id", F.transform(kept, lambda x: x["term"]).alias("t")).collect()}
    assert found == {
        0: ["apple", "banana", "cherry", "damson", "elder"],
        1: ["apple", "banana", "cherry", "fig"],
        2: ["apple", "banana", "pineapple"],
    }


def test_collapsed_start_equals_the_start_of_the_collapsed_text(spark):
    texts = ["", None, " a\t b ", "x" * 9 + "  " + "y" * 30, " " * 50 + "a b", "a" + " " * 50 + "b c d e f g", "ab " * 20, "é 　" * 30]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    rows = frame.select(F.substring(collapse(text), 1, 10).alias("e"), collapsed_start(text, 10).alias("f")).collect()
    assert [r["f"] for r in rows] == [r["e"] for r in rows]
