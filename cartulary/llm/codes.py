"""Product codes of vectors, trained and searched in integers, with Walsh-Hadamard elimination.

A vector becomes integers ``floor(1024 x)`` and is cut into four consecutive parts. Parts and codebook entries are
padded with zeros to a power of two and go through an integer Walsh-Hadamard transform, which multiplies every squared
distance by that power and gathers much of it in the rows of low sequency. Squared differences of the coefficients are
added up in sequency order; an entry leaves as soon as its partial sum exceeds the whole sum of one that is known. Ties
survive and go to the lower index, and nothing is rounded.

A round assigns all rows in tasks that hold the codebooks (4 x 256 entries, whatever the number of rows) and adds up
members per entry and position; the driver receives these sums and forms the next codebooks.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite component take no part, nor do those whose
length differs from that of the smallest id's vector. A null id comes after all ids and is coded like any other; rows
that repeat an id are coded each, and start codebooks in the order of their components. With fewer than 256 vectors
there are as many entries; lengths that four does not divide are filled up with zeros. Components of any finite size
are exact; an error beyond a long is null and counts as none in its label, and a sum beyond a long is null. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import settle

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows that are assigned at once; their partial sums take ``ROWS * ENTRIES`` longs.
ROWS = 1024
_LIMB = 60
_LONG = 2**63 - 1


def sequency_order(length: int) -> list[int]:
    """Rows of the natural Hadamard order by their number of sign changes; ``length`` is a power of two."""
    bits = length.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(length)]
    return [int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray]


def transform(values: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of rows that are padded to a power of two, in sequency order."""
    rows, width = values.shape
    length = 1 << max(0, width - 1).bit_length()
    out = np.zeros((rows, length), values.dtype)
    out[:, :width] = values
    step = 1
    while step < length:
        pairs = out.reshape(rows, length // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, length)
        step *= 2
    return out[:, sequency_order(length)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part and the scaled distance; both sides are coefficients of one length."""
    if parts.dtype == object or entries.dtype == object:
        return _nearest_of_any_size(parts, entries)
    length = parts.shape[1]
    head = max(1, length // 4)
    sums = np.zeros((len(parts), len(entries)), np.int64)
    for at in range(head):
        gap = parts[:, at, None] - entries[None, :, at]
        sums += gap * gap
    bound = _whole(parts, entries, sums.argmin(axis=1))
    rows, columns = np.nonzero(sums <= bound[:, None])
    sums = sums[rows, columns]
    for at in range(head, length):
        gap = parts[rows, at] - entries[columns, at]
        sums = sums + gap * gap
        if at == 2 * head - 1:  # half way, the best so far gives a closer bound
            best = _first_least(rows, sums)
            bound = np.minimum(bound, _whole(parts, entries, columns[best]))
        alive = sums <= bound[rows]
        rows, columns, sums = rows[alive], columns[alive], sums[alive]
    best = _first_least(rows, sums)
    return columns[best], sums[best]


def _whole(parts: np.ndarray, entries: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    gap = parts - entries[chosen]
    return (gap * gap).sum(axis=1)


def _first_least(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Place of the first least sum of every row; ``rows`` ascends and misses none."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    least = np.repeat(np.minimum.reduceat(sums, starts), np.diff(starts, append=len(rows)))
    places = np.flatnonzero(sums == least)
    return places[np.flatnonzero(np.diff(rows[places], prepend=-1))]


def _nearest_of_any_size(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chosen, sums = np.zeros(len(parts), np.int64), np.zeros(len(parts), object)
    for row, part in enumerate(parts.tolist()):
        best = None
        for number, entry in enumerate(entries.tolist()):
            total = 0
            for a, b in zip(part, entry):
                total += (a - b) ** 2
                if best is not None and total >= best:
                    break
            else:
                best, chosen[row] = total, number
        sums[row] = best
    return chosen, sums


def whole_numbers(grid: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles; longs, or objects where longs might not hold it."""
    if not grid.size or np.abs(grid).max() < 2**40:
        return np.floor(grid * scale).astype(np.int64)
    exact = [[math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale for x in row] for row in grid.tolist()]
    return np.array(exact, object).reshape(grid.shape)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` holds the integers of one entry."""

    entries: list[list[list[int]]]
    coefficients: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, entries: list[list[list[int]]]) -> Codebooks:
        kind = np.int64 if all(abs(x) < 2**62 for part in entries for entry in part for x in entry) else object
        return cls(entries, [transform(np.array(part, kind)) for part in entries])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def assign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) indexes and distances of whole vectors of integers."""
        width = values.shape[1] // len(self.entries)
        chosen = np.empty((len(values), len(self.entries)), np.int64)
        errors = np.empty((len(values), len(self.entries)), object)
        for at in range(0, len(values), ROWS):
            rows = slice(at, at + ROWS)
            for part, entries in enumerate(self.coefficients):
                own, there = values[rows, part * width : (part + 1) * width], entries
                size = entries.shape[1]
                largest = max(int(np.abs(own).max(initial=0)), max((abs(x) for e in self.entries[part] for x in e), default=0))
                if 4 * size**2 * largest**2 >= 2**62:
                    own, there = own.astype(object), entries.astype(object)
                index, sums = nearest(transform(own), there)
                chosen[rows, part] = index
                errors[rows, part] = sums // size
        return chosen, errors


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): rows whose vector takes part, before lengths are compared."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where((F.size("embedding") > 0) & sound)


def _grid(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _filled(values: np.ndarray) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, -values.shape[1] % PARTS)))


def _sums(rows: DataFrame, dims: int, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """Members (position -1) and component sums of every (part, entry, position), added up by Spark."""
    width = -(-dims // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            values = _filled(whole_numbers(_grid(batch["embedding"], dims)))
            chosen, _ = books.assign(values)
            for part in range(PARTS):
                order = np.argsort(chosen[:, part], kind="stable")
                own, starts, counts = np.unique(chosen[order, part], return_index=True, return_counts=True)
                if not len(own):
                    continue
                added = np.add.reduceat(values[order, part * width : (part + 1) * width], starts, axis=0)
                for entry, count, row in zip(own.tolist(), counts.tolist(), added.tolist()):
                    for position, x in enumerate([count, *row], -1):
                        key = (part, entry, position)
                        totals[key] = totals.get(key, 0) + x
        out: list[list[int]] = [[], [], [], [], []]
        for key, total in totals.items():
            limb = 0
            while True:  # limbs of 60 bits, the last one with the sign
                last = abs(total) < 2**_LIMB
                low = total if last else total & (2**_LIMB - 1)
                for column, x in zip(out, (*key, limb, low)):
                    column.append(x)
                if last:
                    break
                total, limb = total >> _LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["part", "entry", "position", "limb", "x"])

    found = rows.select("embedding").mapInArrow(run, "part long, entry long, position long, limb long, x long")
    added = found.groupBy("part", "entry", "position", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    totals: dict[tuple[int, int, int], int] = {}
    for r in added.toLocalIterator():  # one row per codebook integer
        key = (r["part"], r["entry"], r["position"])
        totals[key] = totals.get(key, 0) + (int(r["x"]) << (_LIMB * r["limb"]))
    return totals


def train(rows: DataFrame, dims: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and means, from the vectors of the smallest ids."""
    width = -(-dims // PARTS)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    start = _filled(whole_numbers(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), dims))).tolist()
    books = Codebooks.of([[v[part * width : (part + 1) * width] for v in start] for part in range(PARTS)])
    for _ in range(rounds):
        totals = _sums(rows, dims, books)
        moved = [
            [
                [totals[part, entry, at] // totals[part, entry, -1] for at in range(width)] if (part, entry, -1) in totals else old
                for entry, old in enumerate(book)
            ]
            for part, book in enumerate(books.entries)
        ]
        books = Codebooks.of(moved)
    return books


def product_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every vector that takes part."""
    kept = settle(prepared(vectors))
    smallest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("dims")).first()
    dims = smallest["dims"] if smallest else 0
    rows = kept.where(F.size("embedding") == dims)
    books = train(rows, dims, entries, rounds) if smallest else Codebooks([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, errors = books.assign(_filled(whole_numbers(_grid(batch["embedding"], dims))))
            codes = ["".join(f"{x:02x}" for x in row) for row in chosen.tolist()]
            total = [e if e <= _LONG else None for e in map(sum, errors.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array(codes, pa.string()), pa.array(total, pa.int64())], ["vec_id", "label", "code", "error"]
            )

    kind = rows.schema["label"].dataType.simpleString()
    coded = settle(rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"))
    by_label = coded.groupBy("label").agg(F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0)).try_cast("long").alias("label_error"))
    named = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return named.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    floored = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS place, len(v) // {PARTS} AS width FROM kept
), parts AS MATERIALIZED (
  SELECT vec_id, place // width AS part, place % width AS position, x FROM flat
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}
), book0 AS MATERIALIZED (SELECT part, entry, position, x AS c FROM parts JOIN firsts USING (vec_id))"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {ENTRIES} + entry) AS best FROM (
    SELECT vec_id, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM parts JOIN book{n} USING (part, position) GROUP BY ALL
  ) GROUP BY ALL
)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""book{n + 1} AS MATERIALIZED (
  SELECT part, entry, position, coalesce({floored}, c) AS c FROM book{n} LEFT JOIN (
    SELECT part, best % {ENTRIES} AS entry, position, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts JOIN near{n} USING (vec_id, part) GROUP BY ALL
  ) USING (part, entry, position)
)"""
            )
    return f"""WITH {', '.join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, position)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLE = _oracle()
