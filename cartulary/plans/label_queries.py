"""Labels, garbled labels, list items and section parts, over whole lines of the given documents.

The texts hold no labels, so every ninth line or so gets one in front, by position; the rest of the line is the
table's. Lines that are too long for a label or a heading stay what they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import headings as H
from cartulary.operators import sections as S
from cartulary.plans.catalogue import query
from cartulary.plans.section_queries import _DIGITS, _SQL_KEPT, _raw_lines, _sql_level

_FRONTS = 9


def _labelled_lines(spark, folder):
    turn, nth = F.col("i") % _FRONTS, F.floor(F.col("i") / _FRONTS)
    numeral = F.substring(F.lit(_DIGITS), nth.cast("int") % 9 + 1, F.lit(1))
    label = F.get(F.array(*[F.lit(x) for x in H.KNOWN_LABELS]), (nth * 2 % len(H.KNOWN_LABELS)).cast("int"))
    front = (
        F.when((turn == 0) & (nth % 3 == 0), F.concat(F.lit("第"), numeral, F.lit("章 ")))
        .when(turn == 2, F.concat(label, F.lit("：")))
        .when(turn == 3, F.lit("RRR RB: (1) "))
        .when(turn == 4, F.lit("（2） "))
        .when(turn == 5, F.lit("QX B； 形成"))
        .when((turn == 6) & (nth % 4 == 1), F.lit("第一节: (1) "))
        .when(turn == 7, F.lit("(3) 要点: "))
        .otherwise("")
    )
    return _raw_lines(spark, folder).select(
        "document_id",
        (F.floor(F.col("i") / 8) + 1).cast("int").alias("page_number"),
        F.col("i").alias("line_no"),
        F.concat(front, "raw").alias("text"),
        F.lit(None).cast("double").alias("size"),
        F.lit(False).alias("from_ocr"),
    )


_LABELS = "[" + ", ".join(f"'{x}'" for x in H.KNOWN_LABELS) + "]"
_T = "trim(text, ' ' || chr(9) || chr(13))"
_SQL_LINES = f"""
raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, i - 1 AS i, (i - 1) % {_FRONTS} AS turn, (i - 1) // {_FRONTS} AS nth, l[i] AS raw
  FROM (SELECT doc_id, string_split(translate(text, ':;', ',,'), chr(10)) AS l FROM documents),
  LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
fronted AS (
  SELECT document_id, i // 8 + 1 AS page_number, i AS line_no, CASE
    WHEN turn = 0 AND nth % 3 = 0 THEN '第' || substr('{_DIGITS}', CAST(nth % 9 + 1 AS BIGINT), 1) || '章 '
    WHEN turn = 2 THEN {_LABELS}[CAST(nth * 2 % {len(H.KNOWN_LABELS)} + 1 AS BIGINT)] || '：'
    WHEN turn = 3 THEN 'RRR RB: (1) ' WHEN turn = 4 THEN '（2） ' WHEN turn = 5 THEN 'QX B； 形成'
    WHEN turn = 6 AND nth % 4 = 1 THEN '第一节: (1) ' WHEN turn = 7 THEN '(3) 要点: ' ELSE '' END || raw AS text
  FROM raw),
leveled AS (
  SELECT *, {_T} AS t, {_sql_level("text")} AS level FROM fronted WHERE {_T} <> ''),
split AS (
  SELECT *,
    length(t) <= {H.LABEL_LINE_CHARACTERS} AND list_contains({_LABELS}, regexp_extract(t, '^([一-鿿A-Za-z]{{2,12}})\\s*[:：;；]', 1)) AS labelled,
    regexp_extract(t, '^([A-Za-z一-鿿][A-Za-z一-鿿 \\t]{{0,13}})\\s*[:：;；]\\s*(.*)$', ['label', 'rest']) AS parts,
    regexp_matches(t, '[.·…]{{2,}}') OR (regexp_matches(t, '[0-9]\\s*[-–—]?\\s*$') AND level IS NOT NULL) AS entry
  FROM leveled),
contents AS (
  SELECT document_id, page_number FROM split WHERE length(t) >= 3
  GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (entry) / count(*) >= 0.5),
marked AS (
  SELECT s.*, length(t) <= {H.LABEL_LINE_CHARACTERS} AND NOT labelled AND replace(trim(parts.label), ' ', '') <> ''
    AND (length(regexp_replace(parts.label, '[^A-Za-z]', '', 'g')) >= 0.6 * length(replace(trim(parts.label), ' ', ''))
      OR regexp_matches(parts.rest, '^[（(]?\\d')) AS garbled
  FROM split s ANTI JOIN contents c USING (document_id, page_number))"""


@query(
    "label_lines",
    f"""WITH {_SQL_LINES}
SELECT document_id, CAST(line_no AS INTEGER) AS line_no,
  CASE WHEN labelled THEN regexp_extract(t, '^([一-鿿A-Za-z]{{2,12}})', 1) END AS label,
  CASE WHEN labelled THEN trim(regexp_replace(t, '^[一-鿿A-Za-z]{{2,12}}\\s*[:：;；]', '')) END AS rest,
  CASE WHEN garbled THEN trim(parts.label) END AS garbled_label, CASE WHEN garbled THEN trim(parts.rest) END AS garbled_rest
FROM marked WHERE labelled OR garbled""",
)
def label_lines(spark, folder):
    """Known and garbled labels with what follows them, outside contents pages."""
    read = S._classify(_labelled_lines(spark, folder))
    return read.filter(F.col("label").isNotNull() | F.col("noise").isNotNull()).select(
        "document_id",
        S.line_number(F.col("seq")).alias("line_no"),
        F.col("label.label").alias("label"),
        F.col("label.rest").alias("rest"),
        F.col("noise.label").alias("garbled_label"),
        F.col("noise.rest").alias("garbled_rest"),
    )


_STEP = """CASE WHEN c = 0 THEN 0 WHEN c < 4 THEN s | (1 << (c - 1)) ELSE
  CASE WHEN c % 2 = 1 AND s < 4 THEN s | 4 WHEN s & 1 = 0 THEN s | 1 WHEN s & 2 = 0 THEN CASE WHEN c % 2 = 1 THEN s | 4 ELSE s | 2 END
    WHEN s & 4 = 0 THEN s | 4 WHEN c >= 6 THEN 0 ELSE s END END"""


_SQL_REPAIRED = f"""{_SQL_LINES},
coded AS (
  SELECT *, CAST(CASE
    WHEN labelled THEN list_position(['{"', '".join(H.LABEL_SEQUENCE)}'], regexp_extract(t, '^([一-鿿A-Za-z]{{2,12}})', 1))
    WHEN garbled THEN 4 + CASE WHEN starts_with(trim(parts.rest), '形成') THEN 1 ELSE 0 END + CASE WHEN level <= 2 THEN 2 ELSE 0 END
    WHEN level <= 2 THEN 0 END AS BIGINT) AS code
  FROM marked),
label_events AS (SELECT document_id, line_no, code, garbled FROM coded WHERE code IS NOT NULL AND NOT (labelled AND code = 0)),
nth_events AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS n FROM label_events),
codes AS (SELECT document_id, list(code ORDER BY line_no) AS codes FROM label_events GROUP BY document_id),
placed AS (
  SELECT document_id, line_no, code, list_reduce(list_prepend(CAST(0 AS BIGINT), codes[1:n - 1]), lambda s, c: {_STEP}) AS s
  FROM nth_events JOIN codes USING (document_id) WHERE garbled),
repaired AS (SELECT document_id, line_no,
  CASE WHEN code % 2 = 1 AND s < 4 THEN '{H.LABEL_SEQUENCE[2]}' WHEN s & 1 = 0 THEN '{H.LABEL_SEQUENCE[0]}'
    WHEN s & 2 = 0 THEN CASE WHEN code % 2 = 1 THEN '{H.LABEL_SEQUENCE[2]}' ELSE '{H.LABEL_SEQUENCE[1]}' END
    WHEN s & 4 = 0 THEN '{H.LABEL_SEQUENCE[2]}' END AS repaired
FROM placed)"""


@query(
    "repaired_labels",
    f"WITH {_SQL_REPAIRED} SELECT document_id, CAST(line_no AS INTEGER) AS line_no, repaired FROM repaired",
)
def repaired_labels(spark, folder):
    """What each garbled label stands for, from all labels since the last heading."""
    lines = S.garbled_labels(_labelled_lines(spark, folder))
    return lines.select("document_id", S.line_number(F.col("seq")).alias("line_no"), "repaired")


@query(
    "numbered_items",
    f"""WITH {_SQL_LINES},
points AS (
  SELECT document_id, line_no, t, regexp_extract(t, '^([（(]\\s*\\d{{1,2}}\\s*[)）])\\s*(.*)$', ['marker', 'rest']) AS p FROM split),
headed AS (
  SELECT *, trim(p.rest) AS rest, instr(trim(p.rest), ':') AS at_colon FROM points WHERE p.marker <> '')
SELECT document_id, CAST(line_no AS INTEGER) AS line_no,
  CASE WHEN at_colon > 0 AND length(trim(substr(rest, 1, at_colon - 1))) BETWEEN 1 AND 24
    THEN p.marker || ' ' || trim(substr(rest, 1, at_colon - 1)) ELSE substr(t, 1, 24) END AS title,
  CASE WHEN at_colon > 0 AND length(trim(substr(rest, 1, at_colon - 1))) BETWEEN 1 AND 24
    THEN trim(substr(rest, at_colon + 1)) ELSE t END AS body
FROM headed""",
)
def numbered_items(spark, folder):
    """Title and body of every line that starts with a numbered marker."""
    lines = _labelled_lines(spark, folder).filter(F.col("text").rlike(r"^\s*[（(]\s*\d{1,2}\s*[)）]"))
    item = H.numbered_item(F.col("text"))
    return lines.select("document_id", F.col("line_no").cast("int").alias("line_no"), item["title"].alias("title"), item["body"].alias("body"))


_ITEM_REST = "trim(regexp_extract(t, '^[（(]\\s*\\d{1,2}\\s*[)）]\\s*(.*)$', 1))"
_ITEM_HEAD = f"trim(substr({_ITEM_REST}, 1, greatest(instr({_ITEM_REST}, ':') - 1, 0)))"
_ITEM_NAMED = f"instr({_ITEM_REST}, ':') > 0 AND length({_ITEM_HEAD}) BETWEEN 1 AND 24"


@query(
    "label_sections",
    f"""WITH {_SQL_REPAIRED},
known AS (
  SELECT m.*, repaired, regexp_extract(t, '^([一-鿿A-Za-z]{{2,12}})', 1) AS label_name,
    trim(regexp_replace(t, '^[一-鿿A-Za-z]{{2,12}}\\s*[:：;；]', '')) AS label_rest,
    CASE WHEN labelled OR repaired IS NOT NULL THEN 'label' WHEN level IS NOT NULL THEN 'heading' END AS stated
  FROM marked m LEFT JOIN repaired USING (document_id, line_no)),
blocks AS (
  SELECT *, last_value(CASE WHEN stated = 'label' THEN true WHEN stated = 'heading' AND level < 4 THEN false END IGNORE NULLS)
    OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS in_block
  FROM known),
kinds AS (
  SELECT *, CASE WHEN stated = 'heading' AND level = 4 AND NOT coalesce(in_block, false) THEN NULL ELSE stated END AS kind FROM blocks),
parts AS (
  SELECT *, CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS head,
    CASE WHEN kind = 'label' AND labelled THEN CASE
        WHEN label_name = '{H.CASE_LABEL}' AND trim(regexp_extract(label_rest, '^[^，。；;]*')) <> ''
        THEN label_name || '：' || substr(trim(regexp_extract(label_rest, '^[^，。；;]*')), 1, {H.CASE_TITLE_CHARACTERS}) ELSE label_name END
      WHEN kind = 'label' THEN repaired
      WHEN kind = 'heading' AND level = 4 THEN CASE WHEN {_ITEM_NAMED}
        THEN regexp_extract(t, '^([（(]\\s*\\d{{1,2}}\\s*[)）])', 1) || ' ' || {_ITEM_HEAD} ELSE substr(t, 1, 24) END
      WHEN kind = 'heading' THEN t END AS head_title,
    CASE WHEN kind = 'label' AND labelled THEN label_rest WHEN kind = 'label' THEN trim(parts.rest)
      WHEN kind = 'heading' AND level = 4 THEN CASE WHEN {_ITEM_NAMED} THEN trim(substr({_ITEM_REST}, instr({_ITEM_REST}, ':') + 1)) ELSE t END
      WHEN kind IS NULL THEN t END AS piece,
    CASE WHEN kind = 'label' THEN {H.LABEL_LEVEL} ELSE level END AS head_level
  FROM kinds),
cut AS (SELECT *, sum(head) OVER (PARTITION BY document_id ORDER BY line_no) AS s FROM parts),
built AS (
  SELECT document_id, s, min(line_no) AS place,
    coalesce(max(substr(trim(regexp_replace(head_title, '\\s+', ' ', 'g')), 1, 160)) FILTER (head = 1), '前言') AS title,
    coalesce(max(head_level) FILTER (head = 1), 1) AS level,
    trim(coalesce(string_agg(piece, chr(10) ORDER BY line_no) FILTER (trim(coalesce(piece, '')) <> ''), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text
  FROM cut GROUP BY document_id, s),
{_SQL_KEPT}""",
)
def label_sections(spark, folder):
    """Sections of lines with chapters, labels, garbled labels and list items, which count as headings below a label."""
    sections = S.number_sections(S.heading_sections(_labelled_lines(spark, folder)))
    return sections.select("document_id", "section_index", "title", "level", "text")


_CHAPTERS = ("七", "九", "十", "十二", "十九", "三十", "九十八")


def _opened_lines(spark, folder):
    """Pages of eight lines: a short line over numbered sections on each, and a numbered chapter at the end of every fifth."""
    turn = F.col("i") % 8
    chapter = F.get(F.array(*[F.lit(x) for x in _CHAPTERS]), (F.floor(F.col("i") / 40) % len(_CHAPTERS)).cast("int"))
    front = (
        F.when(F.col("i") % 40 == 39, F.concat(F.lit("第"), chapter, F.lit("章 ")))
        .when(turn == 0, F.lit("AB 论 "))
        .when(turn == 1, F.lit("一、"))
        .when(turn == 3, F.lit("(=) "))
        .when(turn == 4, F.lit("二、"))
        .otherwise("")
    )
    return _raw_lines(spark, folder).select(
        "document_id",
        (F.floor(F.col("i") / 8) + 1).cast("int").alias("page_number"),
        F.col("i").alias("line_no"),
        F.concat(front, "raw").alias("text"),
        F.lit(None).cast("double").alias("size"),
        F.lit(False).alias("from_ocr"),
    )


_SQL_OPENED = f"""
raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, i - 1 AS i, l[i] AS raw
  FROM (SELECT doc_id, string_split(translate(text, ':;', ',,'), chr(10)) AS l FROM documents),
  LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
fronted AS (
  SELECT document_id, i // 8 + 1 AS page_number, i AS line_no, CASE
    WHEN i % 40 = 39 THEN '第' || ['{"', '".join(_CHAPTERS)}'][CAST(i // 40 % {len(_CHAPTERS)} + 1 AS BIGINT)] || '章 '
    WHEN i % 8 = 0 THEN 'AB 论 ' WHEN i % 8 = 1 THEN '一、' WHEN i % 8 = 3 THEN '(=) ' WHEN i % 8 = 4 THEN '二、' ELSE '' END || raw AS text
  FROM raw),
leveled AS (SELECT *, {_T} AS t, {_sql_level("text")} AS level FROM fronted WHERE {_T} <> ''),
marked AS (
  SELECT *, regexp_matches(t, '[.·…]{{2,}}') OR (regexp_matches(t, '[0-9]\\s*[-–—]?\\s*$') AND level IS NOT NULL) AS entry FROM leveled),
contents AS (
  SELECT document_id, page_number FROM marked WHERE length(t) >= 3
  GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (entry) / count(*) >= 0.5),
kept AS (SELECT m.* FROM marked m ANTI JOIN contents c USING (document_id, page_number)),
seen AS (
  SELECT *, row_number() OVER p AS n, lead(numbered) OVER p AS next, sum(numbered) OVER (p ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS ahead
  FROM (SELECT *, CAST(regexp_matches(t, '^[一二三四五六七八九十百千万零〇两]{{1,3}}[、.．]\\s*\\S') AS INTEGER) AS numbered FROM kept)
  WINDOW p AS (PARTITION BY document_id, page_number ORDER BY line_no)),
opener AS (
  SELECT document_id, page_number, arg_min(t, n) AS opener FROM seen
  WHERE n <= 8 AND next = 1 AND ahead >= 2 AND level IS NULL AND length(t) <= 40 AND right(t, 1) NOT IN ('。', '；', '，', ';', ',', ':', '：')
  GROUP BY ALL),
events AS (
  SELECT k.*, t = opener AS opens, NOT coalesce(t = opener, false) AND level = 1 AS heads
  FROM kept k LEFT JOIN opener o USING (document_id, page_number) WHERE t = opener OR level = 1),
based AS (
  SELECT *, max(CASE WHEN heads THEN line_no END) OVER (PARTITION BY document_id ORDER BY line_no) AS base FROM events),
counted AS (
  SELECT o.*, h.t AS head, count(*) OVER (PARTITION BY o.document_id, o.base ORDER BY o.line_no) AS nth
  FROM based o LEFT JOIN based h ON h.document_id = o.document_id AND h.line_no = o.base WHERE o.opens),
numbered AS (
  SELECT *, [7, 9, 10, 12, 19, 30, 98][list_position(['{"', '".join(_CHAPTERS)}'], regexp_extract(head, '^第([一二三四五六七八九十]+)章', 1))] + nth AS number,
    trim(regexp_replace(t, '^AB\\s+', '')) AS title FROM counted)"""


@query(
    "chapter_openers",
    f"""WITH {_SQL_OPENED}
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, CAST(line_no AS INTEGER) AS line_no,
  CASE WHEN number <= 99 THEN '第' || CASE WHEN number < 10 THEN substr('零一二三四五六七八九', number + 1, 1)
      ELSE CASE WHEN number < 20 THEN '' ELSE substr('零一二三四五六七八九', number // 10 + 1, 1) END || '十' ||
        CASE WHEN number % 10 = 0 THEN '' ELSE substr('零一二三四五六七八九', number % 10 + 1, 1) END END || '章 ' || title
    ELSE title END AS chapter_title
FROM numbered""",
)
def chapter_openers(spark, folder):
    """Short lines over numbered sections, numbered on from the chapter before them."""
    titles = S.opener_titles(_opened_lines(spark, folder))
    line = S.line_number(F.col("seq"))
    return titles.select("document_id", (F.floor(line / 8) + 1).cast("int").alias("page_number"), line.alias("line_no"), "chapter_title")


@query(
    "repaired_numerals",
    f"""WITH {_SQL_OPENED}
SELECT document_id, CAST(line_no AS INTEGER) AS line_no, substr(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^\\(=\\)', '(二)'), 1, 160) AS title
FROM leveled WHERE level IS NOT NULL""",
)
def repaired_numerals(spark, folder):
    """Headings as titles: one numeral in brackets that scans misread is put right."""
    lines = _opened_lines(spark, folder)
    return lines.filter(H.heading_level(F.col("text")).isNotNull()).select(
        "document_id", F.col("line_no").cast("int").alias("line_no"), H.normalize_heading(F.col("text")).alias("title")
    )
