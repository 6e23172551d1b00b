"""Heading, label and numbering rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import collapse, ends_with_any, let, lstrip, starts_with_any, strip

# Patterns, limits, labels and numerals that decide the result.
HEADING_CHARACTERS = 80
LABEL_LINE_CHARACTERS = 120
TITLE_CHARACTERS = 160
SENTENCE_ENDINGS = ("。", "！", "？", "!", "?")
CLAUSE_ENDINGS = ("，", ",", "；", ";")
NUMERALS = "一二三四五六七八九十百千万零〇两"
NUMBER = f"[0-9{NUMERALS}=Il|≡]"
# In order of precedence; a level of four is a list item.
HEADING_RULES = (
    (r"^[（(]\s*\d{1,2}\s*[)）]\s*\S", 4),
    (rf"^第\s*{NUMBER}+\s*[章篇部]\b", 1),
    (rf"^第\s*{NUMBER}+\s*节\b", 2),
    (rf"^[（(]?[{NUMERALS}]{{1,3}}[)）]?[、.．]\s*\S", 2),
    (rf"^[（(]\s*{NUMBER}{{1,3}}\s*[)）]\s*\S", 3),
    (r"^\d+(?:\.\d+){1,3}\s*\S{1,24}$", 3),
    (r"^\d{1,2}\s*[.．、]\s*(?![0-9])\S", 4),
    (r"(?i)^(?:chapter|section|part)\s+\d+\b", 1),
)
VISUAL_RATIOS = ((1.6, 1), (1.3, 2), (1.15, 3))
VISUAL_ENDINGS = ("。", ".", "；", ";")
DOT_LEADER = "[.·…]{2,}"
PAGE_REFERENCE = r"[-–—\s]*\d{1,4}\s*[-–—]?\s*$"
PAGE_NUMBER_LINE = r"^[-–—\s]*\d{1,4}[-–—\s]*$"
LABEL_LINE = "^([\\u4e00-\\u9fffA-Za-z]{2,12})\\s*[:：;；]\\s*(.*)$"
NOISE_LABEL_LINE = "^([A-Za-z\\u4e00-\\u9fff][A-Za-z\\u4e00-\\u9fff \\t]{0,13})\\s*[:：;；]\\s*(.*)$"
KNOWN_LABELS = (
    "传统发展痛点",
    "发展痛点",
    "数字化赋能路径",
    "数智化赋能路径",
    "赋能路径",
    "数字化赋能成效",
    "数智化赋能成效",
    "赋能成效",
    "典型案例",
)
LABEL_SEQUENCE = ("传统发展痛点", "数智化赋能路径", "数智化赋能成效")
LABEL_LEVEL = 3
ITEM_LEVEL = 4
OUTCOME_MARKERS = ("形成", "构建了", "打造", "实现", "有效")
CASE_LABEL = "典型案例"
CASE_TITLE_CHARACTERS = 26
ITEM_TITLE_CHARACTERS = 24
INLINE_ITEM_BREAK = r"(?<=[。；;：:])\s*(?=[（(]\s*\d{1,2}\s*[)）]\s*\S)"
NUMBERED_ITEM = r"^([（(]\s*\d{1,2}\s*[)）])\s*(.*)$"
TRAILING_MARKER = r"[（(]\s*\d{1,2}\s*[)）]\s*$"
NUMBERED_SECTION = rf"^[{NUMERALS}]{{1,3}}[、.．]\s*\S"
CHAPTER_NUMBER = r"^第\s*([一二三四五六七八九十百零〇两]+)\s*章"
OPENER_NOISE = "^(?:[A-Za-z]{1,4}|\\d{1,3})\\s+(?=[\\u4e00-\\u9fff])"
OPENER_CHARACTERS = 40
OPENER_ENDINGS = ("。", "；", "，", ";", ",", ":", "：")
DIGITS = "零一二三四五六七八九"
BRACKET_NUMBER = rf"^([（(])({NUMBER}{{1,3}})([)）])"
PREAMBLE_TITLE = "前言"
CHAPTER_MARK = r"第\s*[0-9一二三四五六七八九十百千万零〇两=Il|≡]+\s*[章篇部]"
SECTION_MARK = r"(?m)^[（(]?[0-9一二三四五六七八九十=Il|≡]{1,3}[)）]?[、.．]\s*\S"
NUMBERING_PREFIX = (
    r"^(第\s*[0-9一二三四五六七八九十百千]+\s*[章篇部]"
    r"|[（(]\s*[0-9一二三四五六七八九十=Il|]+\s*[)）]"
    r"|[0-9一二三四五六七八九十]+\s*[、.．])"
)
STYLE_HEADING = r"^(?:heading|标题)\s*([1-9])$"
STYLE_TITLES = ("title", "标题", "文档标题")
BODY_OUTLINE_LEVEL = 9
DOCUMENT_TITLE_CHARACTERS = 100
REJECTED_TITLE_PREFIXES = ("摘要", "关键词", "目录", "abstract", "keywords", "key words", "contents")
REJECTED_TITLE_ENDINGS = ("。", "！", "？", "!", "?", "；", ";", "，", ",")
HEADING_HINT = r"^[（(]?[一二三四五六七八九十=Il|0-9]{1,3}[)）]?[、.．:：]?\s*\S"
PROBE_MARKERS = ("（一）", "(一)", "（二）", "(二)", "（三）", "(三)", "（四）", "(四)")


def _u(pattern: str) -> str:
    """Python classes are Unicode-aware; Java's are with this flag."""
    return f"(?U){pattern}"


def heading_level(text: Column) -> Column:
    """Depth implied by the numbering of a line, null when it is no heading."""

    def rules(line: Column) -> Column:
        clause = ends_with_any(line, CLAUSE_ENDINGS)
        eligible = F.length(line).between(1, HEADING_CHARACTERS) & ~ends_with_any(line, SENTENCE_ENDINGS)
        chain = F.when(~eligible, F.lit(None).cast("int"))
        for pattern, level in HEADING_RULES:
            hit = line.rlike(_u(pattern))
            chain = chain.when(hit if level >= ITEM_LEVEL else hit & ~clause, F.lit(level))
        return chain

    return let(strip(text), rules)


def visual_level(text: Column, size: Column, body_size: Column) -> Column:
    """Depth implied by the font size relative to the body text."""
    line = strip(text)
    usable = (
        (body_size > 0) & F.length(line).between(1, HEADING_CHARACTERS) & ~ends_with_any(line, VISUAL_ENDINGS)
    )
    ratio = size / body_size
    chain = F.when(~F.coalesce(usable & size.isNotNull(), F.lit(False)), F.lit(None).cast("int"))
    for bound, level in VISUAL_RATIOS:
        chain = chain.when(ratio >= bound, F.lit(level))
    return chain


def detect_level(text: Column, size: Column, body_size: Column) -> Column:
    return F.coalesce(heading_level(text), visual_level(text, size, body_size))


def is_noise_line(text: Column) -> Column:
    line = strip(text)
    return (
        (line == "") | line.rlike(_u(PAGE_NUMBER_LINE)) | (strip(F.regexp_replace(line, DOT_LEADER, "")) == "")
    )


def looks_like_contents_entry(text: Column, level: Column | None = None) -> Column:
    line = strip(text)
    numbered = (heading_level(line) if level is None else level).isNotNull()
    pointed = line.rlike(_u(PAGE_REFERENCE)) & numbered
    return (F.length(line) >= 3) & (line.rlike(DOT_LEADER) | pointed)


def dedupe_key(title: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(title, DOT_LEADER, ""), _u(PAGE_REFERENCE), "")
    return F.lower(F.regexp_replace(cleaned, _u(r"[\s\-–—_]+"), ""))


def repair_numbering(text: Column) -> Column:
    """``(=)`` is how scans read ``(二)``; the numeral inside the leading brackets is put right."""
    number = F.regexp_extract(text, BRACKET_NUMBER, 2)
    repaired = F.concat(
        F.substring(text, 1, 1),
        F.translate(number, "=≡Il|", "二三一一一"),
        F.substring(text, F.length(number) + 2, F.length(text)),
    )
    return F.when(number != "", repaired).otherwise(text)


def normalize_heading(text: Column) -> Column:
    return F.substring(repair_numbering(collapse(text)), 1, TITLE_CHARACTERS)


_SPLIT_TYPE = "struct<label:string,rest:string>"


def split_label(text: Column) -> Column:
    """``label: rest`` for a known label, else null."""
    line = strip(text)
    label = F.regexp_extract(line, _u(LABEL_LINE), 1)
    return F.when(
        (F.length(line) <= LABEL_LINE_CHARACTERS) & label.isin(*KNOWN_LABELS),
        F.struct(label.alias("label"), strip(F.regexp_extract(line, _u(LABEL_LINE), 2)).alias("rest")),
    )


def split_noise_label(text: Column) -> Column:
    """``label: rest`` where the label is garbled: mostly ASCII letters, or followed by a numbered item."""
    line = strip(text)
    label = strip(F.regexp_extract(line, _u(NOISE_LABEL_LINE), 1))
    rest = F.regexp_extract(line, _u(NOISE_LABEL_LINE), 2)
    compact = F.replace(label, F.lit(" "), F.lit(""))
    letters = F.regexp_count(compact, F.lit("[A-Za-z]"))
    garbled = (letters / F.greatest(F.length(compact), F.lit(1)) >= 0.6) | rest.rlike(_u(r"^[（(]?\d"))
    return F.when(
        (F.length(line) <= LABEL_LINE_CHARACTERS) & split_label(line).isNull() & (compact != "") & garbled,
        F.struct(label.alias("label"), strip(rest).alias("rest")),
    )


def reads_like_outcome(body: Column) -> Column:
    start = lstrip(body)
    return starts_with_any(start, OUTCOME_MARKERS) & ~start.rlike(_u(r"^[（(]?\d"))


def label_title(label: Column, body: Column) -> Column:
    """A case study is named after its own first clause."""
    clause = strip(F.get(F.split(strip(body), "[，。；;]", 2), F.lit(0)))
    return F.when(
        (label == CASE_LABEL) & (clause != ""),
        F.concat(label, F.lit("："), F.substring(clause, 1, CASE_TITLE_CHARACTERS)),
    ).otherwise(label)


def split_inline_items(text: Column) -> Column:
    parts = F.transform(F.split(text, _u(INLINE_ITEM_BREAK)), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def numbered_item(text: Column) -> Column:
    """``struct<title, body>`` of a numbered point; without an inner label the line is both."""

    def shape(line: Column) -> Column:
        marker = F.regexp_extract(line, _u(NUMBERED_ITEM), 1)
        rest = strip(F.regexp_extract(line, _u(NUMBERED_ITEM), 2))
        at = F.instr(rest, ":")
        headline = strip(F.substring(rest, F.lit(1), F.greatest(at - 1, F.lit(0))))
        named = (marker != "") & (at > 0) & F.length(headline).between(1, ITEM_TITLE_CHARACTERS)
        return F.when(
            named,
            F.struct(
                F.concat(marker, F.lit(" "), headline).alias("title"),
                strip(F.substring(rest, at + 1, F.length(rest))).alias("body"),
            ),
        ).otherwise(F.struct(F.substring(line, 1, ITEM_TITLE_CHARACTERS).alias("title"), line.alias("body")))

    return let(strip(text), shape)


def trailing_marker(text: Column) -> Column:
    """The marker at the end of a line without its spaces, null when there is none."""
    found = F.regexp_extract(text, _u(f"({TRAILING_MARKER})"), 1)
    return F.when(found != "", F.regexp_replace(found, _u(r"\s+"), ""))


def without_trailing_marker(text: Column) -> Column:
    return strip(F.regexp_replace(text, _u(TRAILING_MARKER), ""))


def chinese_to_int(numeral: Column) -> Column:
    """Value of a numeral below one hundred, null when it has none."""

    def place(part: Column, absent: int) -> Column:
        at = F.instr(F.lit(DIGITS), part)
        return F.when((part != "") & (at > 0), at - 1).otherwise(F.lit(absent))

    tens, ones = F.substring_index(numeral, "十", 1), F.regexp_replace(numeral, "^[^十]*十", "")
    return (
        F.when(numeral == "", F.lit(None).cast("int"))
        .when(numeral == "十", F.lit(10))
        .when(numeral.contains("百"), F.lit(None).cast("int"))
        .when(numeral.contains("十"), place(tens, 1) * 10 + place(ones, 0))
        .when(F.instr(F.lit(DIGITS), numeral) > 0, F.instr(F.lit(DIGITS), numeral) - 1)
    )


def int_to_chinese(value: Column) -> Column:
    digit = lambda v: F.substring(F.lit(DIGITS), v + 1, F.lit(1))
    tens, ones = F.floor(value / F.lit(10)).cast("int"), (value % 10).cast("int")
    tail = F.when(ones > 0, digit(ones)).otherwise(F.lit(""))
    return (
        F.when(value < 10, digit(value.cast("int")))
        .when(value < 20, F.concat(F.lit("十"), tail))
        .otherwise(F.concat(digit(tens), F.lit("十"), tail))
    )


def chapter_number(title: Column) -> Column:
    found = F.regexp_extract(strip(title), _u(CHAPTER_NUMBER), 1)
    return F.when(found != "", chinese_to_int(found))


def strip_opener_noise(text: Column) -> Column:
    line = strip(text)
    cleaned = strip(F.regexp_replace(line, _u(OPENER_NOISE), ""))
    return F.when(cleaned != "", cleaned).otherwise(line)


def is_numbered_section(text: Column) -> Column:
    return text.rlike(_u(NUMBERED_SECTION))


def could_open_chapter(text: Column, level: Column) -> Column:
    return (F.length(text) <= OPENER_CHARACTERS) & ~ends_with_any(text, OPENER_ENDINGS) & level.isNull()


def looks_like_document_title(text: Column) -> Column:
    return (
        F.length(text).between(1, DOCUMENT_TITLE_CHARACTERS)
        & ~ends_with_any(text, REJECTED_TITLE_ENDINGS)
        & ~starts_with_any(F.lower(text), REJECTED_TITLE_PREFIXES)
        & heading_level(text).isNull()
        & ~is_noise_line(text)
        & ~looks_like_contents_entry(text)
    )


def paragraph_level(text: Column, style_name: Column, outline_level: Column) -> Column:
    """Numbering first, then the style's name, then the outline level (0 to 8)."""
    style = F.lower(strip(F.coalesce(style_name, F.lit(""))))
    numbered_style = F.regexp_extract(style, _u(STYLE_HEADING), 1)
    headed = F.length(text).between(1, HEADING_CHARACTERS) & ~ends_with_any(text, REJECTED_TITLE_ENDINGS)
    styled = (
        F.when(numbered_style != "", numbered_style.try_cast("int"))
        .when(style.isin(*STYLE_TITLES), F.lit(1))
        .when(outline_level.between(0, BODY_OUTLINE_LEVEL - 1), outline_level + 1)
    )
    return F.coalesce(heading_level(text), F.when(headed, styled).cast("int"))


def page_text_score(text: Column) -> Column:
    """How well a reading of a page keeps its structure: chapter marks, section marks, CJK characters."""
    return F.struct(
        F.regexp_count(text, F.lit(_u(CHAPTER_MARK))).alias("chapters"),
        F.regexp_count(text, F.lit(_u(SECTION_MARK))).alias("sections"),
        F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]")).alias("characters"),
    )


def numbering_prefix(title: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(strip(title), _u(NUMBERING_PREFIX), 1), _u(r"\s+"), "")


def found_markers(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(m), F.lit(m)) for m in PROBE_MARKERS]))

