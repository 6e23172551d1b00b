"""Members of ZIP archives, read from their central directory by byte functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import let

# Signatures and places of the ZIP format.
_END, _ENTRY = bytes.fromhex("504b0506"), bytes.fromhex("504b0102")
_END_BYTES, _ENTRY_BYTES, _LONGEST_COMMENT = 22, 46, 65_535
_DIRECTORY_SIZE_AT = 12
_NAME_SIZE_AT, _EXTRA_SIZE_AT, _COMMENT_SIZE_AT = 28, 30, 32


def _number(content: Column, at: Column, size: int) -> Column:
    """Little-endian whole number of ``size`` bytes at a place counted from 0."""
    digits = [F.hex(F.substring(content, at + place + 1, F.lit(1))) for place in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def _marked(content: Column, at: Column, mark: bytes) -> Column:
    return F.substring(content, at + 1, F.lit(4)) == F.lit(mark)


def _end_record(content: Column) -> Column:
    """Place of the end record, null without one. It ends the file, or only its comment follows."""
    last = F.octet_length(content) - _END_BYTES
    comments = F.filter(
        F.sequence(F.lit(1), F.least(last, F.lit(_LONGEST_COMMENT))), lambda skipped: _marked(content, last - skipped, _END)
    )
    scanned = F.when((last > 0) & F.contains(content, F.lit(_END)), last - F.get(comments, F.lit(0)))
    return F.when((last >= 0) & _marked(content, last, _END), last).otherwise(scanned)


def has_zip_member(content: Column, member: bytes) -> Column:
    """Whether ``content`` is a ZIP archive whose central directory lists ``member``; false for anything else."""

    def listed(place: Column) -> Column:
        end, start = place["end"], place["start"]
        begin = F.struct(start.alias("at"), F.lit(False).alias("found"), F.lit(True).alias("sound"))

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            inside = acc["sound"] & (at < end)
            entry = inside & _marked(content, at, _ENTRY)
            name = F.substring(content, at + _ENTRY_BYTES + 1, _number(content, at + _NAME_SIZE_AT, 2).cast("int"))
            sizes = [_number(content, at + field, 2).cast("int") for field in (_NAME_SIZE_AT, _EXTRA_SIZE_AT, _COMMENT_SIZE_AT)]
            return F.struct(
                F.when(entry, at + _ENTRY_BYTES + sizes[0] + sizes[1] + sizes[2]).otherwise(at).alias("at"),
                (acc["found"] | (entry & F.coalesce(name == F.lit(member), F.lit(False)))).alias("found"),
                (acc["sound"] & (entry | (at >= end))).alias("sound"),
            )

        steps = F.sequence(F.lit(1), F.greatest(F.floor((end - start) / F.lit(_ENTRY_BYTES)).cast("int"), F.lit(1)))
        return F.aggregate(steps, begin, step, lambda acc: acc["found"] & acc["sound"])

    def read(end: Column) -> Column:
        start = end - _number(content, end + _DIRECTORY_SIZE_AT, 4).cast("int")
        return F.when(start >= 0, let(F.struct(end.alias("end"), start.alias("start")), listed)).otherwise(F.lit(False))

    return F.coalesce(let(_end_record(content), read), F.lit(False))
