"""Paragraph blocks and overlapping windows as array expressions inside one row (no shuffle).

Nothing is appended in a fold: prefix sums and window chains are found by doubling, so the work of a text grows with its
length times its logarithm.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import doublings, is_blank, let, power_of_two, strip

# Line boundaries as str.splitlines sees them.
_BREAK = r"\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
_RARE_BREAKS = ("\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
_LINE = rf"[^{_BREAK}]*(?:\r\n|[{_BREAK}])|[^{_BREAK}]+"
_SPAN = "struct<start:int,end:int>"
_SLAB = 64


def lines_keeping_ends(text: Column) -> Column:
    """Lines with their terminators. A plain split serves texts whose only line break is the newline."""

    def newline_only(parts: Column) -> Column:
        last = F.size(parts) - 1
        with_ends = F.transform(parts, lambda x, i: F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x))
        return F.when(F.element_at(parts, -1) == "", F.slice(with_ends, F.lit(1), last)).otherwise(with_ends)

    rare = reduce(or_, [text.contains(mark) for mark in _RARE_BREAKS])
    return F.when(
        rare, F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))
    ).otherwise(let(F.split(text, "\n", -1), newline_only))


def split_lines(text: Column) -> Column:
    """Array of lines without their terminators."""
    return F.transform(lines_keeping_ends(text), lambda x: F.regexp_replace(x, rf"(?:\r\n|[{_BREAK}])\z", ""))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers: after each step every sum reaches twice as far back."""

    def doubled(sums: Column, step: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.when(i >= power_of_two(step), F.get(sums, i - power_of_two(step))).otherwise(F.lit(0)))

    return F.aggregate(doublings(F.size(numbers)), numbers, doubled)


def block_spans(text: Column) -> Column:
    """Character spans of runs of non-blank lines: ``array<struct<start, end>>``."""

    def shape(line: Column) -> Column:
        return F.struct(
            F.length(line).alias("width"),
            F.length(F.rtrim(line, F.lit("\r\n"))).alias("inked"),
            is_blank(line).alias("blank"),
        )

    def spans(read: Column) -> Column:
        lines, ends = read["lines"], read["ends"]
        edge = lambda i: F.coalesce(F.get(lines, i)["blank"], F.lit(True))
        begun = lambda x, i: F.when(~x["blank"] & edge(i - 1), F.get(ends, i) - x["width"])
        closed = lambda x, i: F.when(~x["blank"] & edge(i + 1), F.get(ends, i) - x["width"] + x["inked"])
        starts = F.filter(F.transform(lines, begun), lambda x: x.isNotNull())
        closes = F.filter(F.transform(lines, closed), lambda x: x.isNotNull())
        return F.zip_with(starts, closes, _span)

    def summed(lines: Column) -> Column:
        ends = running_sums(F.transform(lines, lambda x: x["width"]))
        return let(F.struct(lines.alias("lines"), ends.alias("ends")), spans)

    return let(F.transform(lines_keeping_ends(text), shape), summed)


def window_spans(blocks: Column, max_characters: int, overlap_characters: int) -> Column:
    """Pack blocks into windows of at most ``max_characters``.

    A block longer than a window is cut every ``max - overlap`` characters; only those cuts overlap. What is
    left of it opens the next window. Where a window that opens at a block ends depends on that block alone, so the
    windows are the chain of such pointers from the first block.
    """
    if max_characters <= 0:
        raise ValueError("max_characters must be positive")
    stride = max_characters - max(0, min(overlap_characters, max_characters - 1))
    cuts = lambda b: F.greatest(F.ceil((b["end"] - b["start"] - max_characters) / F.lit(stride)).cast("int"), F.lit(0))
    opens = lambda b: b["start"] + cuts(b) * stride

    def following(block: Column) -> Column:
        """Index of the first block that ends too late for a window opened at this one, by binary search."""
        limit = opens(block) + max_characters

        def nearer(found: Column, step: Column) -> Column:
            further = found + power_of_two(step)
            return F.when(F.get(blocks, further - 1)["end"] <= limit, further).otherwise(found)

        return F.aggregate(F.reverse(doublings(F.size(blocks) + 1)), F.lit(0), nearer)

    def chained(pointers: Column) -> Column:
        """Blocks that open a window: the chain is twice as long after each step, and pointers reach twice as far."""
        start = F.struct(pointers.alias("jump"), F.array(F.lit(0)).alias("chain"))

        def doubled(acc: Column, _: Column) -> Column:
            onward = lambda i: F.get(acc["jump"], i)
            further = F.filter(F.transform(acc["chain"], onward), lambda i: i < F.size(acc["jump"]))
            jump = F.transform(acc["jump"], lambda i: F.coalesce(onward(i), F.size(acc["jump"])))
            return F.struct(jump.alias("jump"), F.concat(acc["chain"], further).alias("chain"))

        return F.aggregate(doublings(F.size(pointers) + 1), start, doubled, lambda acc: acc["chain"])

    def windows(pointers: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.get(blocks, i)
            hard = F.when(
                cuts(block) > 0,
                F.transform(
                    F.sequence(F.lit(0), cuts(block) - 1),
                    lambda k: _span(block["start"] + k * stride, block["start"] + k * stride + max_characters),
                ),
            ).otherwise(F.array().cast(f"array<{_SPAN}>"))
            return F.concat(hard, F.array(_span(opens(block), F.get(blocks, F.get(pointers, i) - 1)["end"])))

        return F.flatten(F.transform(chained(pointers), at))

    packed = let(F.transform(blocks, following), windows)
    return F.when(F.size(blocks) > 0, packed).otherwise(F.array().cast(f"array<{_SPAN}>"))


def cut_spans(text: Column, spans: Column) -> Column:
    """Attach the stripped text to every span and drop blank ones.

    ``substring`` walks the text from its start, so spans are cut in slabs of 64: a very long section is
    walked once per slab instead of once per span.
    """

    def slab(group: Column) -> Column:
        members = F.slice(spans, group * _SLAB + 1, F.lit(_SLAB))

        def cut(part: Column) -> Column:
            base = part["base"]
            return F.transform(
                members,
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    strip(F.substring(part["body"], s["start"] - base + 1, s["end"] - s["start"])).alias("text"),
                ),
            )

        first = F.element_at(members, 1)["start"]
        last = F.array_max(F.transform(members, lambda s: s["end"]))
        return let(
            F.struct(first.alias("base"), F.substring(text, first + 1, last - first).alias("body")),
            cut,
        )

    groups = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / F.lit(_SLAB)).cast("int"))
    pieces = F.flatten(F.transform(groups, slab))
    return F.filter(pieces, lambda s: ~is_blank(s["text"]))


def split_text(text: Column, max_characters: int, overlap_characters: int) -> Column:
    """``array<struct<start, end, text>>`` of the windows of one section; empty for a blank one."""
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    windows = let(block_spans(text), lambda blocks: window_spans(blocks, max_characters, overlap_characters))
    return F.when(
        ~is_blank(text),
        let(windows, lambda spans: F.when(F.size(spans) > 0, cut_spans(text, spans)).otherwise(empty)),
    ).otherwise(empty)

