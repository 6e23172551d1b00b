"""Pages, lines, bookmarks and paragraphs to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions import headings as H
from cartulary.functions.text import collapse, strip
from cartulary.operators import pages as P
from cartulary.operators.ordered import Carry, composed, neighbour, running
from cartulary.session import settle

# Thresholds and names that decide the result.
MIN_HEADINGS = 2
PREAMBLE_CHARACTERS = 40
MIS_STYLED_CHARACTERS = 24
TITLE_PARAGRAPHS = 5
SOURCE_BOOKMARKS = "pdf_outline"
SOURCE_HEADINGS = "detected_headings"
SOURCE_PAGES = "pages"

_LINE_STEP = 10_000
_PAGE_STEP = 10**12
_LINE_BLOCK = _LINE_STEP * 8192
_EVENT_BLOCK = 256
DOC = ["document_id"]


# ---------------------------------------------------------------- garbled labels


def _label_automaton() -> tuple[list[list[int]], list[list[int]]]:
    """Transitions and repairs over the set of labels seen so far, as a three-bit number.

    Codes: 0 a new chapter or section; 1-3 the known labels in order; 4-7 a garbled label, plus one when its
    body reads like an outcome, plus two when the line would otherwise open a chapter or section.
    """
    after, repair = [[0] * 8], [[-1] * 8]
    for label in range(3):
        after.append([seen | 1 << label for seen in range(8)])
        repair.append([-1] * 8)
    for code in range(4):
        outcome, opens = bool(code & 1), bool(code & 2)
        row_after, row_repair = [], []
        for seen in range(8):
            missing = [label for label in range(3) if not seen >> label & 1]
            label = missing[0] if missing else -1
            if outcome and (2 in missing or label == 1):
                label = 2
            row_repair.append(label)
            row_after.append(seen | 1 << label if label >= 0 else (0 if opens else seen))
        after.append(row_after)
        repair.append(row_repair)
    return after, repair


def _table(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(v) for v in row]) for row in rows])


def _after(effect: Column, state: Column | int) -> Column:
    """State that an effect leads to; an effect holds three bits for each of the eight states."""
    shift = F.lit(3 * state) if isinstance(state, int) else state * 3
    return F.call_function("shiftright", effect, shift).bitwiseAND(7)


def _one_after_other(first: Column, then: Column) -> Column:
    kept = F.lit(0)
    for state in range(8):
        kept = kept.bitwiseOR(F.call_function("shiftleft", _after(then, _after(first, state)), F.lit(3 * state)))
    return kept


def repair_labels(events: DataFrame) -> DataFrame:
    """``(document_id, seq, repaired)`` for garbled label lines; ``repaired`` is null when no label is left.

    ``events``: document_id, seq, code. What a garbled label stands for depends on all labels since the last
    heading. The eight possible states make that an automaton: an event's effect on all states is one number, and
    effects are composed along the document in groups of bounded size.
    """
    after, repair = _label_automaton()
    effects = F.array(*[F.lit(sum(to << 3 * state for state, to in enumerate(row))) for row in after])
    nothing = F.lit(sum(state << 3 * state for state in range(8)))
    reached = composed(
        events.select("document_id", "seq", "code"), DOC, "seq", F.get(effects, F.col("code")), "before", _one_after_other,
        nothing, block_rows=_LINE_BLOCK, fan=_EVENT_BLOCK,
    )
    names = F.array(*[F.lit(label) for label in H.LABEL_SEQUENCE])
    label = F.get(F.get(_table(repair), F.col("code")), _after(F.col("before"), 0))
    return reached.filter("code >= 4").select("document_id", "seq", F.when(label >= 0, F.get(names, label)).alias("repaired"))


# ---------------------------------------------------------------- lines to sections


def line_number(seq: Column) -> Column:
    """``line_no`` of a line's place in its document."""
    return F.floor(seq % _PAGE_STEP / _LINE_STEP).cast("int")


def _classify(lines: DataFrame) -> DataFrame:
    """Per line: opener flag, label split, garbled-label split and level.

    The numbering level of a line decides four things, so it is computed once and stored.
    """
    part = F.col("part") if "part" in lines.columns else F.lit(0)
    numbered = settle(
        lines.select(
            *P.PAGE,
            (F.col("page_number").cast("long") * _PAGE_STEP + F.col("line_no") * _LINE_STEP + part).alias("seq"),
            strip(F.col("text")).alias("text"),
            "size",
            "from_ocr",
            H.heading_level(F.col("text")).alias("numbered"),
        ).filter(F.col("text") != "")
    )
    level = F.col("numbered")
    # What lines learn of their page and document is put together by page, so that their texts move once.
    contents = P.contents_pages(numbered, level).select(*P.PAGE)
    sizes = P.body_sizes(numbered.select(*P.PAGE, "seq", "size").join(contents, P.PAGE, "left_anti"), "seq")
    pages = numbered.select(*P.PAGE).distinct().join(contents, P.PAGE, "left_anti")
    pages = pages.join(P.chapter_openers(numbered, "seq", level), P.PAGE, "left").join(sizes, DOC, "left")
    opened = numbered.join(pages, P.PAGE)
    body = F.when(~F.col("from_ocr"), F.col("body_size"))
    return opened.select(
        *P.PAGE,
        "seq",
        "text",
        F.coalesce(F.col("text") == F.col("opener"), F.lit(False)).alias("opens"),
        H.split_label(F.col("text")).alias("label"),
        H.split_noise_label(F.col("text")).alias("noise"),
        F.coalesce("numbered", H.visual_level(F.col("text"), F.col("size"), body)).alias("level"),
    )


def _label_code() -> Column:
    known = F.array_position(F.array(*[F.lit(x) for x in H.LABEL_SEQUENCE]), F.col("label.label")).cast("int")
    heads = F.coalesce(F.col("level") <= 2, F.lit(False))
    garbled = (
        F.lit(4)
        + F.when(H.reads_like_outcome(F.col("noise.rest")), 1).otherwise(0)
        + F.when(heads, 2).otherwise(0)
    )
    return (
        F.when(F.col("opens"), 0)
        .when(F.col("label").isNotNull(), F.when(known > 0, known))
        .when(F.col("noise").isNotNull(), garbled)
        .when(heads, 0)
    )


def _label_events(lines: DataFrame) -> DataFrame:
    """Coded lines of the documents that have a garbled label. ``lines``: document_id, seq, code, garbled."""
    events = lines.select("document_id", "seq", "code", "garbled")
    affected = events.filter(F.col("garbled")).select("document_id").distinct()
    return events.filter(F.col("code").isNotNull()).drop("garbled").join(affected, DOC, "left_semi")


def _chapter_titles(lines: DataFrame) -> DataFrame:
    """``(document_id, seq, chapter_title)`` for openers: numbered on from the last chapter when it has a number."""
    first = F.when(F.col("level") == 1, F.struct(F.col("seq").alias("seq"), H.chapter_number(H.normalize_heading(F.col("text"))).alias("number")))
    own = H.strip_opener_noise(F.col("text"))
    plain = (F.col("kind") == "heading") & (F.col("level") == 1)
    marked = lines.filter(plain | (F.col("kind") == "opener")).select(
        "document_id", "seq", "kind", "text", F.when(plain, first).alias("chapter")
    )
    based = running(marked, DOC, "seq", [Carry("base", F.col("chapter"), "last")], block_rows=_LINE_BLOCK)
    openers = based.filter(F.col("kind") == "opener").select(
        "document_id",
        "seq",
        own.alias("title"),
        F.coalesce(F.col("base.seq"), F.lit(-1)).alias("base_seq"),
        F.col("base.number").alias("base_number"),
        H.chapter_number(own).alias("own_number"),
    )
    # Without a number to go on from, the first opener that carries one itself starts the count.
    late = (
        openers.filter(F.col("base_number").isNull() & F.col("own_number").isNotNull())
        .groupBy("document_id", "base_seq")
        .agg(F.min(F.struct("seq", "own_number")).alias("late"))
    )
    placed = openers.join(late, ["document_id", "base_seq"], "left").withColumn(
        "counts", (F.coalesce(F.col("late.seq"), F.lit(-1)) < F.col("seq")).cast("int")
    )
    counted = running(
        placed, ["document_id", "base_seq"], "seq", [Carry("nth", F.col("counts"), "sum")], inclusive=True,
        block_rows=_LINE_BLOCK,
    )
    number = F.when(F.col("counts") == 1, F.coalesce("base_number", F.col("late.own_number")) + F.col("nth"))
    return counted.select(
        "document_id",
        "seq",
        F.when(
            number <= 99, F.concat(F.lit("第"), H.int_to_chinese(number), F.lit("章 "), F.col("title"))
        )
        .otherwise(F.col("title"))
        .alias("chapter_title"),
    )


def garbled_labels(lines: DataFrame) -> DataFrame:
    """``(document_id, page_number, seq, text, repaired)`` of the lines whose label is garbled."""
    read = settle(_classify(lines))
    garbled = read.filter(F.col("noise").isNotNull() & F.col("label").isNull() & ~F.col("opens"))
    coded = read.withColumn("code", _label_code()).withColumn("garbled", F.col("noise").isNotNull())
    return garbled.join(repair_labels(_label_events(coded)), ["document_id", "seq"]).select(
        "document_id", "page_number", "seq", "text", "repaired"
    )


def opener_titles(lines: DataFrame) -> DataFrame:
    """``(document_id, seq, chapter_title)`` of the lines that open a chapter without a label."""
    read = _classify(lines)
    kind = F.when(F.col("opens"), "opener").when(F.col("level").isNotNull(), "heading")
    return _chapter_titles(settle(read.withColumn("kind", kind)))


def heading_sections(lines: DataFrame) -> DataFrame:
    """Sections cut at the lines that are headings; documents with fewer than two headings give none.

    ``lines``: document_id, page_number, line_no, text, size, from_ocr and optionally part.
    """
    read = settle(
        _classify(lines).select(
            *P.PAGE,
            "seq",
            "text",
            "opens",
            "level",
            F.col("label").isNotNull().alias("labelled"),
            F.col("noise").isNotNull().alias("garbled"),
            _label_code().alias("code"),
        )
    )
    # Everything up to the cut is decided without the texts, which are joined once afterwards.
    decided = read.drop("text")
    # Garbled labels and unlabelled chapter openers are rare; their work is planned only where they occur.
    if read.filter("garbled").isEmpty():
        repaired = decided.withColumn("repaired", F.lit(None).cast("string"))
    else:
        repaired = decided.join(repair_labels(_label_events(decided)), ["document_id", "seq"], "left")
    known = settle(
        repaired.withColumn(
            "kind",
            F.when(F.col("opens"), "opener")
            .when(F.col("labelled") | F.col("repaired").isNotNull(), "label")
            .when(F.col("level").isNotNull(), "heading"),
        )
    )
    # A list item is a heading only while a label was the last thing above it.
    active = (
        F.when(F.col("kind") == "label", True)
        .when(F.col("kind") == "opener", False)
        .when((F.col("kind") == "heading") & (F.col("level") < H.ITEM_LEVEL), False)
    )
    lean = known.select("document_id", "seq", "kind", "level")
    staged = running(lean, DOC, "seq", [Carry("in_block", active, "last")], block_rows=_LINE_BLOCK)
    item = F.coalesce((F.col("kind") == "heading") & (F.col("level") == H.ITEM_LEVEL), F.lit(False))
    kind = F.when(item & ~F.coalesce("in_block", F.lit(False)), F.lit(None)).otherwise(F.col("kind"))
    staged = staged.withColumn("kind", kind).withColumn("heads", F.col("kind").isNotNull().cast("int"))
    counted = running(
        staged, DOC, "seq", [Carry("section_no", F.col("heads"), "sum")], inclusive=True, block_rows=_LINE_BLOCK
    )
    places = settle(
        known.drop("kind").join(
            counted.select("document_id", "seq", "kind", "heads", "section_no"), ["document_id", "seq"]
        )
    )
    enough = (
        places.groupBy("document_id").agg(F.sum("heads").alias("n")).filter(F.col("n") >= MIN_HEADINGS).select("document_id")
    )
    cut = places.join(enough, DOC, "left_semi")
    texts = read.select("document_id", "seq", "text")
    if places.filter(F.col("kind") == "opener").isEmpty():
        cut = cut.withColumn("chapter_title", F.lit(None).cast("string"))
    else:
        tops = read.filter(F.col("opens") | (F.col("level") == 1)).select("document_id", "seq", "text")
        cut = cut.join(_chapter_titles(cut.join(tops, ["document_id", "seq"])), ["document_id", "seq"], "left")
    titled = (
        texts.join(cut, ["document_id", "seq"])
        .withColumn("label", F.when(F.col("labelled"), H.split_label(F.col("text"))))
        .withColumn("noise", F.when(F.col("repaired").isNotNull(), H.split_noise_label(F.col("text"))))
    )

    point = H.numbered_item(F.col("text"))
    is_item = (F.col("kind") == "heading") & (F.col("level") == H.ITEM_LEVEL)
    rest = F.coalesce("label.rest", F.when(F.col("repaired").isNotNull(), F.col("noise.rest")))
    title = (
        F.when(F.col("kind") == "opener", F.col("chapter_title"))
        .when(F.col("label").isNotNull(), H.label_title(F.col("label.label"), F.col("label.rest")))
        .when(F.col("kind") == "label", F.col("repaired"))
        .when(is_item, point["title"])
        .when(F.col("kind") == "heading", F.col("text"))
    )
    piece = (
        F.when(F.col("kind") == "label", rest)
        .when(is_item, point["body"])
        .when(F.col("kind").isNull(), F.col("text"))
    )
    level = F.when(F.col("kind") == "opener", 1).when(F.col("kind") == "label", H.LABEL_LEVEL).otherwise(F.col("level"))
    pieces = titled.select(
        "document_id", "section_no", "seq", "page_number", "heads", title.alias("title"), piece.alias("piece"), level.alias("level")
    )
    grouped = pieces.groupBy("document_id", "section_no").agg(
        F.min("seq").alias("order"),
        F.min_by("page_number", "seq").alias("page_number"),
        F.max(F.when(F.col("heads") == 1, F.col("title"))).alias("title"),
        F.max(F.when(F.col("heads") == 1, F.col("level"))).alias("level"),
        F.sort_array(
            F.collect_list(F.when(strip(F.col("piece")) != "", F.struct("seq", "piece")))
        ).alias("pieces"),
    )
    built = grouped.select(
        "document_id",
        "order",
        H.normalize_heading(F.coalesce("title", F.lit(H.PREAMBLE_TITLE))).alias("title"),
        F.coalesce("level", F.lit(1)).alias("level"),
        strip(F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n")).alias("text"),
        F.col("page_number").cast("int").alias("page_number"),
    )
    kept = built.filter(
        (F.col("title") != H.PREAMBLE_TITLE) | (F.length(strip(F.col("text"))) >= PREAMBLE_CHARACTERS)
    )
    folded = fold_mis_styled(dedupe_sections(settle(kept)), keep_text=True)
    return align_preamble(folded)


def dedupe_sections(sections: DataFrame) -> DataFrame:
    """Repeated level-1 titles collapse: the longest text, in the place of the first.

    ``sections``: document_id, order, title, level, text and others.
    """
    tops = sections.filter("level = 1")
    choice = (
        tops.groupBy("document_id", H.dedupe_key(F.col("title")).alias("__key"))
        .agg(
            F.min("order").alias("__place"),
            F.max_by("order", F.struct(F.length("text"), -F.col("order"))).alias("order"),
        )
        .drop("__key")
    )
    winners = tops.join(choice, ["document_id", "order"])
    rest = sections.filter("level <> 1").withColumn("__place", F.col("order"))
    return winners.unionByName(rest).withColumn("order", F.col("__place")).drop("__place")


def fold_mis_styled(sections: DataFrame, *, keep_text: bool) -> DataFrame:
    """Long unnumbered titles after a numbered item of the same level are its body text, not headings."""
    block = _LINE_BLOCK
    base = neighbour_level(sections.select("document_id", "order", "title", "level"), block)
    numbered = H.heading_level(F.col("title")).isNotNull()
    changed = F.coalesce(F.col("__before") != F.col("level"), F.lit(True))
    scanned = running(
        base.withColumn("__change", F.when(changed, F.col("order"))),
        DOC,
        "order",
        [
            Carry("__anchor", F.when(numbered & (F.col("level") >= 2), F.col("order")), "max"),
            Carry("__start", F.col("__change"), "max"),
        ],
        block_rows=block,
    )
    start = F.coalesce("__change", "__start")
    body = (
        ~numbered
        & (F.length("title") >= MIS_STYLED_CHARACTERS)
        & F.coalesce(F.col("__anchor") >= start, F.lit(False))
    )
    target = scanned.select(
        "document_id", "order", F.when(body, F.col("__anchor")).otherwise(F.col("order")).alias("__home")
    )
    homed = sections.join(target, ["document_id", "order"])
    kept = homed.filter(F.col("__home") == F.col("order"))
    if not keep_text:
        return kept.drop("__home")
    # Only anchors that received something need their texts joined.
    received = homed.filter(F.col("__home") != F.col("order"))
    parts = (
        received.filter(strip(F.col("text")) != "")
        .groupBy("document_id", "__home")
        .agg(F.sort_array(F.collect_list(F.struct("order", "text"))).alias("__parts"))
        .select(
            "document_id",
            F.col("__home").alias("order"),
            F.transform("__parts", lambda p: p["text"]).alias("__more"),
        )
    )
    own = F.when(strip(F.col("text")) != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    return (
        kept.drop("__home")
        .join(parts, ["document_id", "order"], "left")
        .withColumn(
            "text",
            F.when(F.col("__more").isNotNull(), F.array_join(F.concat(own, F.col("__more")), "\n")).otherwise(
                F.col("text")
            ),
        )
        .drop("__more")
    )


def neighbour_level(sections: DataFrame, block: int) -> DataFrame:
    box = Carry("__box", F.struct(F.col("level").alias("v")), "last")
    return running(sections, DOC, "order", [box], block_rows=block).withColumn("__before", F.col("__box.v")).drop("__box")


def align_preamble(sections: DataFrame) -> DataFrame:
    """A leading preamble takes the level of the section after it when that is deeper."""
    first = Window.partitionBy("document_id").orderBy("order")
    pair = (
        sections.select("document_id", "order", "title", "level")
        .withColumn("__n", F.row_number().over(first))
        .filter(F.col("__n") <= 2)
        .groupBy("document_id")
        .agg(
            F.min("order").alias("order"),
            F.min_by("title", "__n").alias("__title"),
            F.max_by("level", "__n").alias("__deeper"),
        )
        .filter(F.col("__title") == H.PREAMBLE_TITLE)
        .drop("__title")
    )
    return (
        sections.join(pair, ["document_id", "order"], "left")
        .withColumn("level", F.greatest("level", F.coalesce("__deeper", F.lit(0))))
        .drop("__deeper")
    )


def bookmark_sections(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections from embedded bookmarks; a section runs through the page on which the next entry starts.

    ``entries``: document_id, entry_no, level, title, page. Needs at least two entries.
    """
    named = entries.filter(strip(F.coalesce("title", F.lit(""))) != "")
    enough = named.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_HEADINGS)
    named = named.join(enough.select("document_id"), DOC, "left_semi")
    ahead = neighbour(named, DOC, "entry_no", F.col("page"), "__next", following=True)
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("__last"))
    spans = ahead.join(last, DOC).select(
        "document_id",
        (F.col("entry_no").cast("long") * _LINE_STEP).alias("order"),
        H.normalize_heading(strip(F.col("title"))).alias("title"),
        F.greatest(F.lit(1), F.least(F.col("level").cast("int"), F.lit(6))).alias("level"),
        F.greatest(F.col("page").cast("int"), F.lit(1)).alias("start_page"),
        F.col("page").cast("int").alias("__from"),
        F.least(F.greatest(F.coalesce("__next", "__last"), F.col("page")), F.col("__last")).cast("int").alias("__to"),
    )
    # Page numbers are listed and joined by equality: each section meets exactly its own pages.
    listed = spans.filter(F.col("__from") <= F.col("__to")).select(
        "document_id", "order", F.explode(F.sequence("__from", "__to")).alias("page_number")
    )
    texts = (
        listed.join(pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), "text"), P.PAGE)
        .groupBy("document_id", "order")
        .agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("__texts"))
        .select("document_id", "order", strip(F.array_join(F.transform("__texts", lambda t: t["text"]), "\n")).alias("text"))
        .filter(F.col("text") != "")
    )
    kept = spans.join(texts, ["document_id", "order"]).select(
        "document_id", "order", "title", "level", "text", F.col("start_page").alias("page_number")
    )
    return fold_mis_styled(kept, keep_text=False)


def number_sections(sections: DataFrame) -> DataFrame:
    """Replace ``order`` by a dense ``section_index`` and put the page into ``source_locations``."""
    numbered = running(
        sections.withColumn("order", F.col("order").cast("long")),
        DOC,
        "order",
        [Carry("__index", F.lit(1), "sum")],
        block_rows=_LINE_BLOCK,
    )
    location = F.struct(F.col("page_number").cast("int").alias("page_number"), F.lit(None).cast("int").alias("paragraph_index"))
    return numbered.select(
        "document_id",
        F.col("__index").cast("int").alias("section_index"),
        "title",
        F.col("level").cast("int").alias("level"),
        "text",
        F.array(location).alias("source_locations"),
    )


def choose_structure(bookmarked: DataFrame, headed: DataFrame, paged: DataFrame) -> DataFrame:
    """Per document: bookmarks, else headings, else pages; says which in ``structure_source``."""
    columns = ["document_id", "order", "title", "level", "text", "page_number"]
    tag = lambda frame, name: frame.select(*columns).withColumn("structure_source", F.lit(name))
    first = bookmarked.select("document_id").distinct()
    second = headed.select("document_id").distinct().unionByName(first)
    return (
        tag(bookmarked, SOURCE_BOOKMARKS)
        .unionByName(tag(headed.join(first, DOC, "left_anti"), SOURCE_HEADINGS))
        .unionByName(tag(paged.join(second, DOC, "left_anti"), SOURCE_PAGES))
    )


# ---------------------------------------------------------------- paragraphs to sections


def document_titles(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``(document_id, title)``: stated title, else the first title-like opening paragraph, else the file name.

    ``documents``: document_id, stated_title, file_stem.
    """
    order = Window.partitionBy("document_id").orderBy("paragraph_index")
    opening = (
        paragraphs.select("document_id", "paragraph_index", collapse(F.col("text")).alias("text"))
        .filter(F.col("text") != "")
        .withColumn("__n", F.row_number().over(order))
        .filter(F.col("__n") <= TITLE_PARAGRAPHS)
        .filter(H.looks_like_document_title(F.col("text")))
        .groupBy("document_id")
        .agg(F.min_by("text", "__n").alias("__opening"))
    )
    filled = lambda c: F.when(strip(c) != "", strip(c))
    return documents.join(opening, DOC, "left").select(
        "document_id",
        F.coalesce(filled(F.col("stated_title")), "__opening", filled(F.col("file_stem")), "file_stem").alias("title"),
    )


def paragraph_sections(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """Sections of word-processor documents.

    ``paragraphs``: document_id, paragraph_index, text, style_name, outline_level. Every paragraph of a
    section adds a source location. Opening paragraphs that repeat the document title are skipped.
    """
    read = (
        paragraphs.filter(strip(F.col("text")) != "")
        .join(titles.select("document_id", collapse(F.col("title")).alias("__title")), DOC, "left")
        .withColumn("body", strip(F.col("text")))
        .withColumn("line", collapse(F.col("body")))
        .withColumn("level", H.paragraph_level(F.col("line"), F.col("style_name"), F.col("outline_level")))
    )
    # A heading is read as a line, any other paragraph as a body: one text each.
    same = F.coalesce((F.col("line") == F.col("__title")) & (F.col("__title") != ""), F.lit(False))
    staged = settle(
        read.select(
            "document_id",
            "paragraph_index",
            F.when(F.col("level").isNull(), F.col("body")).alias("body"),
            F.when(F.col("level").isNotNull(), F.col("line")).alias("line"),
            "level",
            same.alias("__same"),
        )
    )
    begun = running(staged, DOC, "paragraph_index", [Carry("__begun", (~F.col("__same")).cast("int"), "sum")])
    content = begun.filter(~(F.col("__same") & (F.col("__begun") == 0)))
    cut = running(
        content,
        DOC,
        "paragraph_index",
        [Carry("section_index", F.col("level").isNotNull().cast("int"), "sum")],
        inclusive=True,
    )
    head = F.col("level").isNotNull()
    location = F.struct(
        F.lit(None).cast("int").alias("page_number"), F.col("paragraph_index").cast("int").alias("paragraph_index")
    )
    grouped = cut.groupBy("document_id", "section_index").agg(
        F.max(F.when(head, F.col("line"))).alias("title"),
        F.max("level").alias("level"),
        F.sort_array(F.collect_list(F.struct("paragraph_index", F.when(~head, F.col("body")).alias("body"), location.alias("at")))).alias("parts"),
    )
    next_level = grouped.filter("section_index = 1").select("document_id", F.col("level").alias("__next"))
    shift = grouped.filter("section_index = 0").select("document_id", F.lit(0).alias("__shift"))
    bodies = F.filter(F.transform("parts", lambda p: p["body"]), lambda b: b.isNotNull())
    return (
        grouped.join(next_level, DOC, "left")
        .join(shift, DOC, "left")
        .select(
            "document_id",
            (F.col("section_index") - F.when(F.col("__shift").isNull(), 1).otherwise(0)).cast("int").alias("section_index"),
            F.when(F.col("section_index") == 0, F.lit(H.PREAMBLE_TITLE)).otherwise(F.col("title")).alias("title"),
            F.when(F.col("section_index") == 0, F.greatest(F.lit(1), F.coalesce("__next", F.lit(1))))
            .otherwise(F.col("level"))
            .alias("level"),
            F.array_join(bodies, "\n").alias("text"),
            F.transform("parts", lambda p: p["at"]).alias("source_locations"),
        )
    )
