"""Pages, lines, bookmarks and paragraphs to sections, on hand-made documents."""

import random

from pyspark.sql import functions as F

from cartulary.config import Settings
from cartulary.operators import pages as P
from cartulary.operators import sections as S
from cartulary.operators.ordered import composed

LINE = "document_id string, page_number int, line_no int, text string, size double, from_ocr boolean"


def lines_of(spark, pages, document="d", size=12.0, ocr=False):
    rows = []
    for page_number, texts in enumerate(pages, start=1):
        for line_no, text in enumerate(texts):
            text, own = text if isinstance(text, tuple) else (text, size)
            rows.append((document, page_number, line_no, text, own, ocr))
    return spark.createDataFrame(rows, LINE)


def shape(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("document_id", "order").collect()]


def test_clean_lines_moves_markers_and_splits_items(spark):
    lines = lines_of(spark, [["12", "促进沉淀; (2)", "固化为模型", "痛点: (1) 甲; (3) 乙", "(4)"]])
    got = [r["text"] for r in P.clean_lines(lines).orderBy("line_no", "part").collect()]
    assert got == ["促进沉淀;", "(2) 固化为模型", "痛点:", "(1) 甲;", "(3) 乙"]


def test_contents_pages_and_body_size(spark):
    lines = lines_of(spark, [["第一章 总论 …… 1", "第二章 方法 …… 5", "目录页"], ["正文一行文字", "正文两行文字", "正文三行文字"]])
    assert [r["page_number"] for r in P.contents_pages(lines).collect()] == [1]
    sizes = lines_of(spark, [[("a", 10.0), ("b", 12.04), ("c", 12.0), ("d", 10.0)]])
    assert P.body_sizes(sizes).first()["body_size"] == 10.0


def test_best_version_prefers_structure(spark):
    rows = [("d", 1, 0, "第一章 总论"), ("d", 1, 1, "总论总论总论总论"), ("d", 2, 0, "甲乙"), ("d", 2, 1, "丙丁")]
    got = P.best_page_versions(spark.createDataFrame(rows, "document_id string, page_number int, version int, text string"))
    assert {r["page_number"]: r["version"] for r in got.collect()} == {1: 0, 2: 0}


def test_prepare_pages_replaces_thin_pages_up_to_the_cap(spark):
    pages = spark.createDataFrame([("d", n, "" if n > 1 else "一个足够长的页面文字内容啊") for n in range(1, 5)], "document_id string, page_number int, text string")
    versions = spark.createDataFrame([("d", n, 0, "扫描得到的正文\n一、章节") for n in (2, 3, 4)], "document_id string, page_number int, version int, text string")
    lines = lines_of(spark, [["一个足够长的页面文字内容啊"]]).drop("from_ocr")
    merged, cleaned = P.prepare_pages(pages, lines, versions, Settings(replacement_max_pages=2))
    assert sorted((r["page_number"], r["from_ocr"]) for r in merged.collect()) == [(1, False), (2, True), (3, True)]
    assert cleaned.filter("page_number = 3").count() == 2


def test_headings_labels_and_items(spark):
    lines = lines_of(
        spark,
        [
            ["开篇说明文字" * 8, "第一章 总论", "章节正文", "一、背景", "1. 列表不是标题"],
            ["传统发展痛点: (1) 甲", "(2) 乙类: 说明文字", "RRR RB: (1) 路径", "EEE: 形成了效果", "（一）小节", "(3) 普通列表"],
        ],
    )
    got = S.heading_sections(lines)
    assert shape(got, "title", "level", "text") == [
        ("前言", 1, "开篇说明文字" * 8),
        ("第一章 总论", 1, "章节正文"),
        ("一、背景", 2, "1. 列表不是标题"),
        ("传统发展痛点", 3, "(1) 甲"),
        ("(2) 乙类", 4, "说明文字"),
        ("数智化赋能路径", 3, "(1) 路径"),
        ("数智化赋能成效", 3, "形成了效果"),
        ("（一）小节", 3, "(3) 普通列表"),
    ]


def test_one_heading_is_no_structure(spark):
    assert S.heading_sections(lines_of(spark, [["第一章 总论", "正文"]])).count() == 0


def test_unlabelled_openers_continue_the_chapter_numbers(spark):
    opener = lambda name: [name, "一、甲", "正文", "二、乙"]
    got = S.heading_sections(lines_of(spark, [["第五章 旧章", "一、起"], opener("AB 智能制造"), opener("绿色发展")]))
    assert [t for t, level in shape(got, "title", "level") if level == 1] == ["第五章 旧章", "第六章 智能制造", "第七章 绿色发展"]


def test_running_headers_collapse_and_preamble_aligns(spark):
    got = S.heading_sections(
        lines_of(spark, [["第一章 总论", "短"], ["第一章 总论 ", "更长的一段正文"], ["第二章 方法", "正文"]])
    )
    assert shape(got, "title", "text") == [("第一章 总论", "更长的一段正文"), ("第二章 方法", "正文")]
    aligned = S.heading_sections(lines_of(spark, [["前面的说明文字" * 8, "一、背景", "甲", "二、方法", "乙"]]))
    assert shape(aligned, "title", "level") == [("前言", 2), ("一、背景", 2), ("二、方法", 2)]


def _sections(spark, rows):
    return spark.createDataFrame(
        [("d", i * 10_000, t, l, x, 1) for i, (t, l, x) in enumerate(rows)],
        "document_id string, order long, title string, level int, text string, page_number int",
    )


def test_mis_styled_titles_fold_into_the_numbered_item(spark):
    long = "这是一段被误当成标题的完整正文句子其长度超过二十四个字"
    rows = [("1.优化策略", 4, "甲"), (long, 4, "乙"), ("参考文献", 4, ""), (long + "二", 4, "丙"), (long + "三", 3, "丁")]
    assert shape(S.fold_mis_styled(_sections(spark, rows), keep_text=True), "title", "text") == [
        ("1.优化策略", "甲\n乙\n丙"),
        ("参考文献", ""),
        (long + "三", "丁"),
    ]
    assert shape(S.fold_mis_styled(_sections(spark, rows), keep_text=False), "text")[0] == ("甲",)


def test_fold_equals_a_sequential_reading(spark):
    rng = random.Random(7)
    long = "这是一段被误当成标题的完整正文句子其长度超过二十四个字"
    rows = [(rng.choice(["一、甲", "短题", long]), rng.choice([1, 2, 2, 3]), str(i)) for i in range(200)]
    kept, anchor, want = [], None, []
    for title, level, text in rows:
        if anchor is not None and want[anchor][1] != level:
            anchor = None
        if title == "一、甲" and level >= 2:
            want.append([title, level, text])
            anchor = len(want) - 1
        elif title == long and anchor is not None:
            want[anchor][2] += "\n" + text
        else:
            want.append([title, level, text])
    got = shape(S.fold_mis_styled(_sections(spark, rows), keep_text=True), "title", "level", "text")
    assert got == [tuple(w) for w in want]


def test_bookmarks_run_through_the_next_start_page(spark):
    pages = spark.createDataFrame([("d", n, f"p{n}") for n in (1, 2, 3)], "document_id string, page_number int, text string")
    entries = spark.createDataFrame([("d", 0, 1, " A ", 1), ("d", 1, 9, "B", 2), ("d", 2, 0, "C", 3), ("e", 0, 1, "only", 1)], "document_id string, entry_no int, level int, title string, page int")
    got = S.bookmark_sections(entries, pages)
    assert shape(got, "title", "level", "text") == [("A", 1, "p1\np2"), ("B", 6, "p2\np3"), ("C", 1, "p3")]
    chosen = S.choose_structure(got, S.heading_sections(lines_of(spark, [["x"]])), P.page_sections(pages.unionByName(spark.createDataFrame([("f", 1, "t")], pages.schema))))
    assert {(r["document_id"], r["structure_source"]) for r in chosen.collect()} == {("d", "pdf_outline"), ("f", "pages")}
    numbered = S.number_sections(got).orderBy("section_index").collect()
    assert [(r["section_index"], r["source_locations"][0]["page_number"]) for r in numbered] == [(0, 1), (1, 2), (2, 3)]


def test_paragraph_sections(spark):
    rows = [
        ("d", 0, "研究报告", "Normal", None),
        ("d", 1, "  导言  文字 ", "Normal", None),
        ("d", 2, "", "Normal", None),
        ("d", 3, "Method", "Heading 2", None),
        ("d", 4, "做法", "Normal", None),
        ("e", 0, "Intro", "Heading 1", None),
    ]
    paragraphs = spark.createDataFrame(rows, "document_id string, paragraph_index int, text string, style_name string, outline_level int")
    documents = spark.createDataFrame([("d", None, "file"), ("e", " Stated ", "file2")], "document_id string, stated_title string, file_stem string")
    titles = S.document_titles(documents, paragraphs)
    assert {r["document_id"]: r["title"] for r in titles.collect()} == {"d": "研究报告", "e": "Stated"}
    got = S.paragraph_sections(paragraphs, titles).orderBy("document_id", "section_index").collect()
    assert [(r["document_id"], r["section_index"], r["title"], r["level"], r["text"], [x["paragraph_index"] for x in r["source_locations"]]) for r in got] == [
        ("d", 0, "前言", 2, "导言  文字", [1]),
        ("d", 1, "Method", 2, "做法", [3, 4]),
        ("e", 0, "Intro", 1, "", [0]),
    ]


def test_label_automaton_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "_EVENT_BLOCK", 5)
    after, repair = S._label_automaton()
    rng = random.Random(3)
    codes = [rng.choice([0, 1, 2, 3, 4, 4, 5, 5, 6, 7]) for _ in range(120)]
    want, state = {}, 0
    for seq, code in enumerate(codes):
        if code >= 4:
            label = repair[code][state]
            want[seq] = S.H.LABEL_SEQUENCE[label] if label >= 0 else None
        state = after[code][state]
    events = spark.createDataFrame([("d", seq, code) for seq, code in enumerate(codes)], "document_id string, seq long, code int")
    for fan in (2, 5, 256):
        monkeypatch.setattr(S, "_EVENT_BLOCK", fan)
        assert {r["seq"]: r["repaired"] for r in S.repair_labels(events).collect()} == want
    assert S.repair_labels(events.limit(0)).count() == 0


def test_labels_of_one_long_document_are_dealt_out(spark):
    after, repair = S._label_automaton()
    codes = spark.range(200_000).select(F.lit("d").alias("document_id"), F.col("id").alias("seq"), F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("code"))
    state, want = 0, {None: 0, **{label: 0 for label in S.H.LABEL_SEQUENCE}}
    for r in codes.orderBy("seq").collect():
        if r["code"] >= 4:
            label = repair[r["code"]][state]
            want[S.H.LABEL_SEQUENCE[label] if label >= 0 else None] += 1
        state = after[r["code"]][state]
    repaired = S.repair_labels(codes)
    assert {r["repaired"]: r["count"] for r in repaired.groupBy("repaired").count().collect()} == want


def test_composition_of_texts(spark):
    """Concatenation does not commute, so order shows."""
    rows = [(k, n * 3, chr(97 + (n * 7 + len(k)) % 26)) for k in ("x", "yy") for n in range(40 + 30 * len(k))]
    frame = spark.createDataFrame(rows, "k string, n long, c string").repartition(3)
    for fan in (2, 3, 128):
        found = composed(frame, ["k"], "n", F.col("c"), "before", lambda a, b: F.concat(a, b), F.lit(""), block_rows=20, fan=fan)
        for k in ("x", "yy"):
            own = [c for x, _, c in rows if x == k]
            assert [r["before"] for r in found.where(F.col("k") == k).orderBy("n").collect()] == ["".join(own[:i]) for i in range(len(own))]


def test_texts_are_written_once_a_step(spark, monkeypatch):
    seen, write = [], S.settle
    monkeypatch.setattr(S, "settle", lambda frame: seen.append(write(frame)) or seen[-1])
    S.heading_sections(lines_of(spark, [["第一章 总论", "正文", "第二章 方法", "又一行"]])).collect()
    assert sum("text" in frame.columns for frame in seen) == 3
    seen.clear()
    rows = [("d", 0, "一、背景", "Normal", None), ("d", 1, "正文", "Normal", None)]
    paragraphs = spark.createDataFrame(rows, "document_id string, paragraph_index int, text string, style_name string, outline_level int")
    titles = spark.createDataFrame([("d", "t")], "document_id string, title string")
    S.paragraph_sections(paragraphs, titles).collect()
    assert [frame.filter("body IS NOT NULL AND line IS NOT NULL").count() for frame in seen] == [0]
