"""Whitespace, trimming and small formatting expressions.

Python's notion of whitespace is wider than Java's default one. The class is spelt out once, as a pattern
and as a trim set, because a spelt-out class matches several times faster than the ``(?U)`` property.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points for which str.isspace() holds.
SPACE_CODES = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
SPACE_CHARACTERS = "".join(map(chr, SPACE_CODES))
SPACE_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_SET}]"
INK = f"[^{SPACE_SET}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it often at the cost of one evaluation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doublings(size: Column) -> Column:
    """0, 1, ... while ``2 ** step`` is below ``size``; one step at least."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(size.cast("double"))).cast("int") - 1, F.lit(0)))


def power_of_two(step: Column) -> Column:
    return F.pow(F.lit(2.0), step).cast("int")


def explode_once(frame: DataFrame, keep: list, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element, where ``array`` is costly to compute and its elements are not null.

    For a plain ``explode`` the optimizer infers filters on the array's size and nullness and pushes them
    down, so that the array is computed three times per row, partly in the scan. It infers none for an outer one.
    """
    if position is None:
        rows = frame.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = frame.select(*keep, F.posexplode_outer(array).alias(position, name))
    return rows.filter(F.col(name).isNotNull())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARACTERS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARACTERS))


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one space and the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def collapsed_start(text: Column, limit: int) -> Column:
    """The first ``limit`` characters of ``collapse``; the rest of a long text is read where its start is mostly white space."""

    def cut(start: Column) -> Column:
        done = (F.length(start) >= limit) | (F.length(text) <= 2 * limit)
        return F.substring(F.when(done, start).otherwise(collapse(text)), 1, limit)

    return let(collapse(F.substring(text, 1, 2 * limit)), cut)


#: What a text without it has of white space is single spaces; the class holds no space of ``SPACE_CODES`` but U+0020.
_UNTIDY = r"[^ -~\u00a1-\u167f]|  "


def tidy(text: Column) -> Column:
    """``collapse`` for a column that is cheap to repeat: a look for anything to collapse is cheaper than replacing."""
    return F.when(text.rlike(_UNTIDY), collapse(text)).otherwise(F.trim(text))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def ends_with_any(text: Column, endings: tuple[str, ...]) -> Column:
    """True when the last character is one of ``endings`` (single characters)."""
    return F.right(text, F.lit(1)).isin(*endings) & (F.length(text) > 0)


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    checks = [text.startswith(prefix) for prefix in prefixes]
    result = checks[0]
    for check in checks[1:]:
        result = result | check
    return result


def quote_excerpt(text: Column, limit: int = 240) -> Column:
    return F.substring(collapse(text), 1, limit)


def location_label(page_number: Column, paragraph_index: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("p."), page_number.cast("string")),
        F.concat(F.lit("¶"), (paragraph_index + 1).cast("string")),
        F.lit("source"),
    )


def primary_page(locations: Column) -> Column:
    return F.get(F.filter(F.transform(locations, lambda x: x["page_number"]), lambda p: p.isNotNull()), F.lit(0))


def primary_paragraph(locations: Column) -> Column:
    return F.get(F.filter(F.transform(locations, lambda x: x["paragraph_index"]), lambda p: p.isNotNull()), F.lit(0))


def trim_to(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def shorten(text: Column, limit: int, *, collapsed: bool = False) -> Column:
    """Cut at the first listed separator whose last use lies in the second half of the window.

    ``collapsed`` states that the text's white space is single spaces already.
    """
    # Fixed values, in order of preference.
    separators = ("，", "、", ",", "；", ";", " ")

    def cut(clean: Column) -> Column:
        window = F.substring(clean, 1, limit)

        def at(separator: str) -> Column:
            # 0-based index of the last occurrence, -1 when absent
            return F.when(
                F.instr(window, separator) > 0,
                F.length(window) - F.instr(F.reverse(window), separator),
            ).otherwise(F.lit(-1))

        branch = F.when(F.length(clean) <= limit, clean)
        for separator in separators:
            branch = branch.when(at(separator) >= limit // 2, F.trim(F.substring(window, F.lit(1), at(separator))))
        return branch.otherwise(F.trim(window))

    return let(text if collapsed else collapse(text), cut)
