"""Best-fit packing of tokenized documents by linear grouping on the length histogram.

Pieces are at most ``capacity`` long, so the histogram of their lengths has at most ``capacity`` entries, however many
documents there are, and a plan is made on counts: large lengths are put in groups of equal cardinality and rounded
up to their group's largest, column generation optimises the few-size configurations, actual lengths take the
rounded places, and the rest is best-fit into what is left. The plan lists runs of alike sequences; every piece finds
its place from its rank among the pieces of its length.

Defined cases: a null or empty text is the closing id alone; a null ``doc_id`` is packed like any other and stays
null; repeated rows are packed each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import settle

CAPACITY = 2048
KEPT_GAPS = (2048, 32, 16, 8, 4, 2, 1)
CLOSING_ID = (0).to_bytes(4, "little")
_UNUSUAL_SPACE = re.compile("[\x1c-\x1f]")
_MARKS_AT_END = re.compile(r"(?<=[0-9A-Za-z])([!-/:-@\[-^`{-~]+)(?!\S)")
_MARKS_AT_ANY_END = re.compile(r"(?<=[^\W_])([!-/:-@\[-^`{-~]+)(?!\S)")
_TOGETHER = 200
#: Words that the tokenizer gets at once, and characters of the texts that are split at once.
_WORDS_AT_ONCE, _CHARACTERS_AT_ONCE = 8000, 2_000_000


@cache
def _ending_in_marks() -> re.Pattern:
    """Letters and digits that no longer end in one after the tokenizer's NFC and lower-casing; ASCII marks join their end.

    The planes beyond the second hold ideographs alone, which have no such form.
    """
    ends = lambda c: unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0]
    return re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and ends(c) not in "LN") + "]")


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer ends every token at white space, and between a letter or digit and ASCII marks that end a word (in
    texts with letters whose normal form ends in a combining mark, only after ASCII ones), so such words and marks are encoded once and kept; an ASCII text is lower-cased first, as the tokenizer does. The
    first ``limit`` words met are kept, which hold the frequent ones; others are encoded again in each block. Words of
    letters alone are encoded many at a time and told apart by the tokens that end a word. Texts with the four
    separators that only Python calls white space, or that may hold a special token, are encoded whole.
    """

    def __init__(self, tokenizer_file: str, limit: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.known: dict[str, bytes] = {}
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w.isalpha()]
        groups = [plain[at : at + _TOGETHER] for at in range(0, len(plain), _TOGETHER)]
        rest, out = [w for w in words if not w.isalpha()], {}
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(group) or ends[-1] != 4 * len(ids):
                rest += group
                continue
            packed, start = ids.tobytes(), 0
            for word, end in zip(group, ends.tolist()):
                out[word], start = packed[start:end], end
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[word] = self._pack(found.ids)
        return out

    def _words(self, text: str) -> list[str] | None:
        if _UNUSUAL_SPACE.search(text) or ("<|" in text and "|>" in text):
            return None
        if text.isascii():
            return _MARKS_AT_END.sub(r" \1", text).lower().split()
        marks = _MARKS_AT_END if _ending_in_marks().search(text) else _MARKS_AT_ANY_END
        return marks.sub(r" \1", text).split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; as many texts are split at once as their characters allow."""
        at = 0
        while at < len(texts):
            end, room = at + 1, _CHARACTERS_AT_ONCE - len(texts[at])
            while end < len(texts) and len(texts[end]) <= room:
                room -= len(texts[end])
                end += 1
            yield from self._block(texts[at:end])
            at = end

    def _block(self, texts: list[str]) -> list[bytes]:
        split, known, fresh = [self._words(t) for t in texts], self.known, {}
        missing = list(set().union(*(words for words in split if words)).difference(known))
        for at in range(0, len(missing), _WORDS_AT_ONCE):
            fresh |= self._encoded(missing[at : at + _WORDS_AT_ONCE])
        stays = len(known) + len(fresh) <= self.limit
        known.update(fresh)
        found = [self._whole(t) if words is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, split)]
        if not stays:
            for word in fresh:
                del known[word]
        return found

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)


_ENCODERS: dict[str, WordIds] = {}


def word_ids(tokenizer_file: str) -> WordIds:
    """The worker's encoder; tasks that follow each other in a worker share its words."""
    if tokenizer_file not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores; threads would each hold memory
        _ENCODERS[tokenizer_file] = WordIds(tokenizer_file)
    return _ENCODERS[tokenizer_file]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row with the writing task's number and the piece's number among those of its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(tokenizer_file), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                block, rows = batch.slice(at, 500), []
                texts = [t or "" for t in block["text"].to_pylist()]
                for doc, ids in zip(block["doc_id"].to_pylist(), encoder.encode(texts)):
                    ids += CLOSING_ID
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        length = len(cut) // 4
                        rows.append((doc, piece, start // 4, length, zlib.crc32(cut), part, int(seen[length])))
                        seen[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = [f.split()[0] for f in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, PIECES
    )


@dataclass
class Run:
    """``count`` sequences that hold the same lengths."""

    count: int
    lengths: list[int]
    gap: int


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best configuration of unbounded items; ``sizes`` ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        fit = np.searchsorted(sizes, room, "right")
        gain = values[:fit] + best[room - sizes[:fit]]
        top = int(gain.argmax())
        best[room], choice[room] = best[room - 1], -1
        if gain[top] > best[room]:
            best[room], choice[room] = gain[top], top
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """(times, counts per size): column generation for the fractional optimum, rounded down.

    Stops at the optimum, within a thousandth of its lower bound, or after ``rounds`` columns; any stop gives
    valid configurations.
    """
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        times = np.linalg.solve(basis, demand)
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _knapsack(sizes, np.maximum(prices, 0.0), capacity)
        if value <= 1.001:
            break
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, np.maximum(times, 0.0) / np.maximum(direction, 1e-9), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.maximum(np.linalg.solve(basis, demand), 0.0)
    return [(int(n + 1e-9), basis[:, i]) for i, n in enumerate(times) if n >= 1]


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 128, small: int | None = None) -> list[Run]:
    """Runs of alike sequences that hold every piece of the histogram (lengths from 1 to ``capacity``) once."""
    small = capacity // 16 if small is None else small
    large = sorted(((s, n) for s, n in histogram.items() if n and s > small), reverse=True)
    total = sum(n for _, n in large)
    runs: list[Run] = []
    left: list[list[int]] = []
    if total:
        share = -(-total // min(groups, total))
        pools: list[list[list[int]]] = []
        room = 0
        for size, count in large:
            while count:
                if not room:
                    pools.append([])
                    room = share
                taken = min(room, count)
                pools[-1].append([size, taken])
                room, count = room - taken, count - taken
        merged: dict[int, list[list[int]]] = {}
        for pool in pools:
            merged.setdefault(pool[0][0], []).extend(pool)
        sizes = np.array(sorted(merged), np.int64)
        demand = np.array([sum(n for _, n in merged[int(s)]) for s in sizes], float)
        for times, counts in configurations(sizes, demand, capacity):
            slots = [int(s) for s, c in zip(sizes, counts) for _ in range(int(round(c)))]
            while times > 0:
                heads, need = [], {}
                for slot in slots:
                    need[slot] = need.get(slot, 0) + 1
                if any(not merged[slot] for slot in need):
                    break
                # alike sequences: each group gives its largest length; a length short of one per place goes singly
                step = times
                for slot, places in need.items():
                    step = min(step, merged[slot][0][1] // places)
                if step == 0:
                    if any(sum(n for _, n in merged[slot]) < places for slot, places in need.items()):
                        break
                    step = 1
                    for slot, places in need.items():
                        for _ in range(places):
                            heads.append(_take(merged[slot], 1))
                else:
                    for slot, places in need.items():
                        size = merged[slot][0][0]
                        heads += [size] * places
                        merged[slot][0][1] -= step * places
                        if not merged[slot][0][1]:
                            merged[slot].pop(0)
                runs.append(Run(step, heads, capacity - sum(heads)))
                times -= step
        left = [pair for pool in merged.values() for pair in pool if pair[1]]
    rest: Counter = Counter({s: n for s, n in histogram.items() if n and s <= small})
    for size, count in left:
        rest[size] += count
    # small documents may not suffice for the gaps that rounding leaves: the configurations that stay are those whose
    # actual lengths fill them best, and the documents of the others are best-fit as well
    best: list[Run] | None = None
    for gap in KEPT_GAPS:
        again, kept = rest.copy(), []
        for run in runs:
            if run.gap <= gap:
                kept.append(Run(run.count, run.lengths, run.gap))
            else:
                for size in run.lengths:
                    again[size] += run.count
        packed = _best_fit(kept, again, capacity)
        if best is None or sum(r.count for r in packed) < sum(r.count for r in best):
            best = packed
    return best or []


def _take(pool: list[list[int]], count: int) -> int:
    size = pool[0][0]
    pool[0][1] -= count
    if not pool[0][1]:
        pool.pop(0)
    return size


def _best_fit(runs: list[Run], rest: dict[int, int], capacity: int) -> list[Run]:
    """Longest first into the fullest sequences that have room; new sequences where none has."""
    by_gap: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        by_gap[run.gap].append(run)

    def put(run: Run, size: int, count: int) -> int:
        each = run.gap // size
        whole, odd = divmod(count, each)
        if whole >= run.count:
            whole, odd = run.count, 0
        for times, copies in ((whole, each), (1 if odd else 0, odd), (run.count - whole - (1 if odd else 0), 0)):
            if times:
                changed = Run(times, run.lengths + [size] * copies, run.gap - size * copies)
                by_gap[changed.gap].append(changed)
        return count - whole * each - odd

    for size in sorted(rest, reverse=True):
        count = rest[size]
        for gap in range(size, capacity + 1):
            while count and by_gap[gap]:
                count = put(by_gap[gap].pop(), size, count)
            if not count:
                break
        if count:
            put(Run(-(-count // (capacity // size)), [], capacity), size, count)
    return [run for bucket in by_gap for run in bucket]


def plan_table(runs: list[Run]) -> dict[str, np.ndarray]:
    """Per place of a run: length, first rank, first sequence and offset, sorted by length and first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for size in run.lengths:
            rows.append((size, used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + run.count
            offset += size
        sequence += run.count
    grid = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (grid[:, 0] << 48) | grid[:, 1], "rank": grid[:, 1], "sequence": grid[:, 2], "offset": grid[:, 3], "total": np.array([sequence])}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, groups: int = 128) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its sequence and offset.

    The driver sees one count per length. The plan that tasks receive has at most a few places per pair of length
    group and length, so its size does not grow with the documents.
    """
    cut = settle(pieces(docs, tokenizer_file, capacity))
    counts = settle(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("pieces")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    histogram.pop(capacity, None)
    plan = plan_table(plan_runs(histogram, capacity, groups))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(starts, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            full = length == capacity
            at = np.searchsorted(plan["key"], (length << 48) | rank, "right") - 1
            at[full] = 0
            if len(plan["key"]):
                sequence, offset = plan["sequence"][at] + rank - plan["rank"][at], plan["offset"][at]
            else:
                sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            sequence = np.where(full, plan["total"][0] + rank, sequence)
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(np.where(full, 0, offset))], [f.split()[0] for f in PACKED.split(", ")]
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)
