"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``trigger`` bytes marks phrase starts: a position is a trigger where its hash is the least of the
``reach + 1`` positions from some start on. So every string of ``length`` bytes contains the trigger that its own bytes
choose, and equal strings choose it at the same place. The starts that share a trigger form one parse entry: the
phrase before the trigger and the context behind it. Ordering entries by their phrase context brings all suffixes with
equal prefixes together, which is what the merged suffix arrays of dictionary and parse are for; the order used here
is that of two 64-bit digests, since only equal prefixes matter and not which is smaller.

1. Dictionary: entries are counted by trigger context (the bytes behind the trigger that all its strings share) and by
   whole content. Whole content seen twice: every start repeats. Trigger context seen once: none does.
2. Parse: the remaining entries, and one representative of each repeated content beside them, are split into groups of
   ``step`` starts at fixed distances from the trigger, counted in the same two ways, and the rest start by start.

Each step is a count by digest, so one passage in a third of all texts costs no more than many rare ones.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; a null ``doc_id`` takes part like any
other row; repeated rows repeat each other's strings; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from cartulary.llm.neardup_sketch import mix64
from cartulary.llm.words import word_codes
from cartulary.session import settle

_PRIME = 0x100000001B3
SLAB = 1 << 20


@dataclass(frozen=True)
class Parsing:
    """``length`` bytes must repeat, or as many words, which count by a 64-bit hash each and part at ASCII white space. A
    trigger lies within ``reach`` of them of a start, inside the string."""

    length: int = 400
    trigger: int = 16
    step: int = 16
    words: bool = False

    @property
    def reach(self) -> int:
        return min(256, (self.length - self.trigger) * 2 // 3)

    def symbols(self, text: bytes) -> np.ndarray:
        return word_codes(text) if self.words else np.frombuffer(text, np.uint8)


def trigger_of_start(data: np.ndarray, parsing: Parsing) -> np.ndarray:
    """For each start of a string of ``length`` bytes in ``data``: the position of its trigger."""
    starts = len(data) - parsing.length + 1
    if starts <= 0:
        return np.empty(0, np.int64)
    out = []
    for at in range(0, starts, SLAB):
        count = min(SLAB, starts - at)
        part = data[at : at + count + parsing.reach + parsing.trigger - 1]
        rolled, size = mix64(part.astype(np.uint64) + np.uint64(1)), 1
        factor = _PRIME
        while size < parsing.trigger:
            rolled = rolled[:-size] * np.uint64(factor) + rolled[size:]
            factor, size = factor * factor % 2**64, size * 2
        # the low bits carry the position, so that equal hashes give the leftmost
        least = (mix64(rolled) & ~np.uint64(2 * SLAB - 1)) | np.arange(len(rolled), dtype=np.uint64)
        span = 1
        while 2 * span <= parsing.reach + 1:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        rest = parsing.reach + 1 - span
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        out.append((least[:count] & np.uint64(2 * SLAB - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def entries_of(symbols: np.ndarray, parsing: Parsing) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, trigger) of each parse entry."""
    triggers = trigger_of_start(symbols, parsing)
    if len(triggers):
        edges = np.flatnonzero(np.diff(triggers)) + 1
        yield from zip(
            np.concatenate(([0], edges)).tolist(), np.concatenate((edges - 1, [len(triggers) - 1])).tolist(),
            triggers[np.concatenate(([0], edges))].tolist(),
        )


_KEYED = StructType([StructField("row_key", LongType()), StructField("doc_id", LongType()), StructField("packed", BinaryType())])
_ENTRY = "row_key long, first int, last int, at int, near long, whole long"


def _digest(run: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit digest; entries are equal where the digests of context and of whole content both are."""
    value = xxhash.xxh3_64_intdigest(run, seed)
    return value - 2**64 if value >= 2**63 else value


def _carried(docs: DataFrame, names: tuple[str, ...]) -> list[StructField]:
    """Fields of the columns that only pass through, under names that cannot clash."""
    return [StructField(f"carried_{i}", docs.schema[name].dataType) for i, name in enumerate(names)]


def _packed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a key of their own and their text compressed, so that it moves cheaply."""
    fields = _carried(docs, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, nth = zstandard.ZstdCompressor(level=3), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                block = batch.slice(at, 2000)
                keys = pa.array(np.arange(nth, nth + block.num_rows) + (part << 40))
                nth += block.num_rows
                texts = [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in block["text"].to_pylist()]
                passed = [block[f.name] for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [keys, block["doc_id"], pa.array(texts, pa.binary()), *passed], ["row_key", "doc_id", "packed", *(f.name for f in fields)]
                )

    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *(docs[name].alias(f.name) for name, f in zip(carry, fields)),
    )
    return own.mapInArrow(run, StructType([*_KEYED.fields, *fields]))


def _parse(packed: DataFrame, parsing: Parsing) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                block, rows = batch.slice(at, 500), []
                for key, data in zip(block["row_key"].to_pylist(), block["packed"].to_pylist()):
                    run_of = parsing.symbols(unpack.decompress(data))
                    for first, last, trigger in entries_of(run_of, parsing):
                        near = _digest(run_of[trigger : trigger + parsing.length - parsing.reach], 1)
                        rows.append((key, first, last, trigger, near, _digest(run_of[first : last + parsing.length])))
                yield _arrow(rows, _ENTRY)

    return packed.select("row_key", "packed").mapInArrow(run, _ENTRY)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _judge(entries: DataFrame) -> DataFrame:
    """Entries with ``state``: 2 all starts repeat, 1 open, 0 representative of a repeated content among open ones."""
    by_whole = entries.groupBy("near", "whole").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row_key", "first")).alias("one")
    )
    by_near = by_whole.groupBy("near").agg(F.count(F.lit(1)).alias("contents"), F.sum("times").alias("met")).where("met > 1")
    known = settle(by_whole.join(by_near, "near").select("near", "whole", "times", "contents", "one"))
    found = entries.join(known, ["near", "whole"])
    chosen = F.struct("row_key", "first") == F.col("one")
    state = F.when(F.col("times") > 1, F.lit(2)).when(F.col("contents") > 1, F.lit(1))
    return settle(
        found.withColumn("state", state).where("state is not null")
        .select("row_key", "first", "last", "at", "state", ((F.col("contents") > 1) & (chosen | (F.col("times") == 1))).alias("finer"))
    )


_FINER = f"{_ENTRY}, known boolean"


def _finer(packed: DataFrame, open_rows: DataFrame, parsing: Parsing, step: int) -> DataFrame:
    """Groups of at most ``step`` starts, cut at fixed distances from the trigger; step 1 gives single starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                block, rows = batch.slice(at, 200), []
                for key, data, pieces in zip(*(block[c].to_pylist() for c in ("row_key", "packed", "pieces"))):
                    run_of = parsing.symbols(unpack.decompress(data))
                    for piece in pieces:
                        trigger, last = piece["at"], piece["last"]
                        while last >= piece["first"]:
                            distance = (trigger - last) // step * step  # of the group's nearest start
                            first = max(piece["first"], trigger - distance - step + 1)
                            near = _digest(run_of[trigger - distance : trigger - distance - step + 1 + parsing.length], 2 + distance)
                            rows.append((key, first, last, trigger, near, _digest(run_of[first : last + parsing.length]), piece["state"] == 2))
                            last = first - 1
                kinds = _arrow([r[:-1] for r in rows], _ENTRY)
                yield pa.RecordBatch.from_arrays([*kinds.columns, pa.array([r[-1] for r in rows], pa.bool_())], [f.split()[0] for f in _FINER.split(", ")])

    pieces = open_rows.groupBy("row_key").agg(F.collect_list(F.struct("first", "last", "at", "state")).alias("pieces"))
    return settle(packed.join(pieces, "row_key").select("row_key", "packed", "pieces").mapInArrow(run, _FINER))


def repeated_starts(packed: DataFrame, parsing: Parsing) -> DataFrame:
    """(row_key, first, last): ranges of starts whose string also starts elsewhere. A row has boundedly many."""
    judged = _judge(settle(_parse(packed, parsing)))
    ranges = judged.where("state = 2").select("row_key", "first", "last")
    for step in (parsing.step, 1):
        open_rows = judged.where("finer")
        judged = _judge(_finer(packed, open_rows, parsing, step).drop("known"))
        ranges = ranges.unionByName(judged.where("state = 2").select("row_key", "first", "last"))
    return ranges


def merged_spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal covered runs [from, to)."""
    spans: list[list[int]] = []
    for piece in sorted(ranges, key=lambda r: r["first"]):
        end = piece["last"] + length
        if spans and piece["first"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([piece["first"], end])
    return [tuple(s) for s in spans]


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


def byte_spans(text: bytes, spans: list[tuple[int, int]], parsing: Parsing) -> list[tuple[int, int]]:
    """The bytes of spans of symbols; of words, with the white space between them."""
    if not parsing.words or not spans:
        return spans
    bounds = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    return [(bounds[first][0], bounds[end - 1][1]) for first, end in spans]


def _cut(packed: DataFrame, ranges: DataFrame, parsing: Parsing, whole_characters: bool, schema: StructType) -> DataFrame:
    """Rows with sizes, digest and the bytes that are left, and whatever else ``packed`` carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                block, rows = batch.slice(at, 1000), []
                for data, ranges in zip(block["packed"].to_pylist(), block["ranges"].to_pylist()):
                    text = unpack.decompress(data)
                    spans = byte_spans(text, merged_spans(ranges or [], parsing.length), parsing)
                    if whole_characters:
                        spans = [_grown(text, s) for s in spans]
                    kept = cut_out(text, spans)
                    rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                made = _arrow(rows, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
                made = {n: c for n, c in zip(made.schema.names, made.columns)}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else block[n] for n in schema.names], list(schema.names))

    return packed.join(ranges, "row_key", "left").mapInArrow(run, schema)


def _grouped(packed: DataFrame, parsing: Parsing) -> DataFrame:
    return repeated_starts(packed, parsing).groupBy("row_key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def remove_repeats(docs: DataFrame, parsing: Parsing = Parsing()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs(doc_id, text)``."""
    packed = settle(_packed(docs))
    counts = [StructField(n, LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    return _cut(packed, _grouped(packed, parsing), parsing, False, StructType([*counts, StructField("kept_sha256", StringType())]))


def without_repeats(docs: DataFrame, parsing: Parsing) -> DataFrame:
    """The rows of ``docs`` with the text that is left; a removed run grows to the characters that it touches.

    A null text stays null, other columns are unchanged.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    packed = settle(_packed(docs.withColumn("no_text", F.col("text").isNull()), (*others, "no_text")))
    fields = [StructField("doc_id", LongType()), StructField("kept", BinaryType())]
    kept = _cut(packed, _grouped(packed, parsing), parsing, True, StructType([*fields, *(f for f in packed.schema if f.name.startswith("carried_"))]))
    text = F.when(~F.col(f"carried_{len(others)}"), F.col("kept").cast("string")).alias("text")
    names = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"carried_{i}").alias(c) for i, c in enumerate(others)}
    return kept.select(*(names[c] for c in docs.columns))


def _grown(text: bytes, span: tuple[int, int]) -> tuple[int, int]:
    start, end = span
    while start > 0 and text[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(text) and text[end] & 0xC0 == 0x80:
        end += 1
    return start, end
