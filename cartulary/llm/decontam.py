"""Benchmark decontamination: a BM25 index of test items, block-max WAND per training passage, then overlap.

An item's question is its text up to the last sentence, its answer the last sentence. Items longer than
``SEGMENT`` words are indexed in segments. A passage is ``2 * SEGMENT`` words and starts every ``SEGMENT``, so each
segment lies whole in some passage. Impacts are BM25 weights divided by the segment's own score, so a score is the
share of a segment's weight that a passage holds. Every segment at or above ``THRESHOLD`` is retrieved: passages are
first bounded by block maxima, and those that may qualify walk the posting lists in WAND order and skip blocks whose
maxima cannot reach the threshold. A retrieved item is a leak when the passage's document holds at least 0.8 of the
five-word shingles of its question and of its answer (shorter parts: the part as one shingle), or of the whole item,
so that one changed word in a short last sentence hides no copy.

The index is broadcast in shards of at most ``SHARD`` segments; more items mean more shards, each queried by every
passage. Words are counted by Spark; the driver holds the items and word counts of one shard at a time.

Defined cases: null and empty texts have no passages; null or wordless items are not indexed; repeated items are found
each; a null ``doc_id`` is reported as null; no items or no rows give no leaks; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import settle

SEGMENT = 96
THRESHOLD = 0.5
OVERLAP = 0.8
SHARD = 2_000
BLOCK = 8
WIDTH = 5
K1, B = 1.2, 0.75
FLOOR = THRESHOLD - 1e-9
_END = 2**62
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?]\s+|\n")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(found: list[str]) -> set[tuple[str, ...]]:
    size = min(WIDTH, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before the last sentence and words of it; a single sentence is cut after four fifths of its words."""
    marks = [m.end() for m in _SENTENCE.finditer(text) if words(text[: m.end()]) and words(text[m.end() :])]
    if marks:
        return words(text[: marks[-1]]), words(text[marks[-1] :])
    found = words(text)
    cut = -(-4 * len(found) // 5)
    return found[:cut], found[cut:]


class Index:
    """Inverted index of one shard of items, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], documents: int, frequency: dict[str, int], mean: float) -> None:
        self.items = items
        self.parts = [question_and_answer(text) for _, text in items]
        segments = [(i, found[at : at + SEGMENT]) for i, (_, t) in enumerate(items) for found in [words(t)] for at in range(0, len(found), SEGMENT)]
        self.owner = [i for i, _ in segments]
        self.blocks = -(-len(segments) // BLOCK)
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for number, (_, found) in enumerate(segments):
            counts = Counter(found)
            weights = {
                w: np.log1p((documents - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(found) / mean))
                for w, n in counts.items()
            }
            own = sum(weights.values())
            for w, x in weights.items():
                lists[w].append((number, x / own))
        self.ids = {w: n for n, w in enumerate(lists)}
        self.postings = [lists[w] for w in self.ids]
        self._split_common(len(segments))

    def _split_common(self, segments: int) -> None:
        """Common words whose whole weight stays under half the threshold in every segment cannot qualify one alone."""
        mass = np.zeros(segments)
        self.common = np.zeros(len(self.postings), bool)
        for word in sorted(range(len(self.postings)), key=lambda w: -len(self.postings[w])):
            if len(self.postings[word]) < 3:
                break
            grown = mass.copy()
            for segment, weight in self.postings[word]:
                grown[segment] += weight
            if grown.max() < THRESHOLD / 2:
                mass, self.common[word] = grown, True
        padded = np.zeros(self.blocks * BLOCK)
        padded[:segments] = mass
        self.base = padded.reshape(-1, BLOCK).max(axis=1) if segments else np.zeros(0)

    @cached_property
    def maxima(self) -> np.ndarray:
        """word x block: greatest weight of an uncommon word within a block."""
        out = np.zeros((len(self.postings), self.blocks), np.float32)
        for word, held in enumerate(self.postings):
            if not self.common[word]:
                for segment, weight in held:
                    out[word, segment // BLOCK] = max(out[word, segment // BLOCK], weight)
        return out

    @cached_property
    def by_block(self) -> list[dict[int, tuple[float, list[tuple[int, float]]]]]:
        """word -> block -> (greatest weight, postings) of the block."""
        out: list[dict[int, tuple[float, list[tuple[int, float]]]]] = []
        for held in self.postings:
            own: dict[int, list[tuple[int, float]]] = {}
            for posting in held:
                own.setdefault(posting[0] // BLOCK, []).append(posting)
            out.append({block: (max(x for _, x in part), part) for block, part in own.items()})
        return out

    def wand(self, query: list[int], blocks: Iterable[int] | None = None) -> list[int]:
        """Segments whose score over the distinct words of ``query`` reaches the threshold, block by block."""
        found: list[int] = []
        for block in range(self.blocks) if blocks is None else blocks:
            lists = [part for w in query if (part := self.by_block[w].get(block))]
            if sum(most for most, _ in lists) >= FLOOR:  # else the block's maxima cannot reach it
                found += self._walk([[held[0][0], most, held, 0] for most, held in lists])
        return found

    def _walk(self, cursors: list[list]) -> list[int]:
        """WAND order: lists by their next segment; the pivot is the first place whose maxima reach the threshold."""
        found = []
        while True:
            cursors.sort(key=itemgetter(0))
            total, pivot = 0.0, None
            for place, cursor in enumerate(cursors):
                total += cursor[1]
                if total >= FLOOR:
                    pivot = place
                    break
            if pivot is None:
                return found
            target = cursors[pivot][0]
            if cursors[0][0] == target:
                score = 0.0
                for cursor in cursors:
                    if cursor[0] != target:
                        break
                    score += cursor[2][cursor[3]][1]
                if score >= FLOOR:
                    found.append(target)
                target += 1
            left = []
            for cursor in cursors:
                while cursor[0] < target:
                    cursor[3] += 1
                    cursor[0] = cursor[2][cursor[3]][0] if cursor[3] < len(cursor[2]) else _END
                if cursor[0] != _END:
                    left.append(cursor)
            cursors = left

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Item number -> (score, question overlap, answer overlap) of the leaks in a text."""
        found = words(text)
        ids = np.fromiter((self.ids.get(w, -1) for w in found), np.int64, len(found))
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return {}
        size = len(self.postings)
        pairs = []
        for back in (0, 1):  # each word lies in the passage that starts in its segment and in the one before
            passage = known // SEGMENT - back
            pairs.append((passage * size + ids[known])[passage >= 0])
        unique = np.unique(np.concatenate(pairs))
        passage, word = unique // size, unique % size
        edges = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        bounds = np.add.reduceat(self.maxima[word], edges, axis=0) + self.base
        out: dict[int, tuple[float, float, float]] = {}
        held: set | None = None
        ends = np.append(edges[1:], len(word))
        for row in np.flatnonzero(bounds.max(axis=1) >= THRESHOLD - 1e-6):
            query = word[edges[row] : ends[row]].tolist()
            for segment in self.wand(query, np.flatnonzero(bounds[row] >= THRESHOLD - 1e-6).tolist()):
                item = self.owner[segment]
                if item in out:
                    continue
                if held is None:
                    held = set(zip(*(found[k:] for k in range(WIDTH))))
                shares = []
                for part in (*self.parts[item], sum(self.parts[item], [])):
                    needed = grams(part)
                    if part and len(part) < WIDTH:
                        wanted = next(iter(needed))
                        shares.append(float(any(tuple(found[i : i + len(part)]) == wanted for i in range(len(found)))))
                    else:
                        shares.append(len(needed & held) / len(needed) if needed else 1.0)
                if min(shares[:2]) >= OVERLAP or shares[2] >= OVERLAP:
                    inside = set(query)
                    score = sum(x for w in inside for s, x in self.postings[w] if s == segment)
                    out[item] = (float(score), shares[0], shares[1])
        return out


def _segments(text: str) -> list[list[str]]:
    found = words(text)
    return [found[at : at + SEGMENT] for at in range(0, len(found), SEGMENT)]


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that have words, with their numbers of words and segments."""
    for batch in batches:
        rows = [(i, t, len(words(t)), len(_segments(t))) for i, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist())]
        columns = list(zip(*(r for r in rows if r[2]))) or [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["item_id", "text", "n_words", "n_segments"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): in how many segments of the batch each word occurs."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch["text"].to_pylist():
            for cut in _segments(text):
                counts.update(set(cut))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def shards(items: DataFrame) -> Iterator[Index]:
    """Indexes of at most ``SHARD`` segments each (or one longer item), in order of ``item_id``; statistics are of all
    items. The driver takes the items partition by partition, and of the word counts those of one shard."""
    spark = items.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sized = settle(own.mapInArrow(_sized, "item_id long, text string, n_words long, n_segments long"))
    total, segments = sized.agg(F.sum("n_words"), F.sum("n_segments")).first()
    if not segments:
        return
    counted = settle(sized.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))

    def index(group: list[tuple[int, str]]) -> Index:
        wanted = spark.createDataFrame([(w,) for w in sorted({w for _, text in group for w in words(text)})], "word string")
        return Index(group, segments, {r["word"]: r["n"] for r in counted.join(wanted, "word").collect()}, total / segments)

    group: list[tuple[int, str]] = []
    room = 0
    for row in sized.orderBy("item_id", "text").toLocalIterator():
        if room < row["n_segments"]:
            if group:
                yield index(group)
            group, room = [], SHARD
        group.append((row["item_id"], row["text"]))
        room -= row["n_segments"]
    yield index(group)


_LEAK = "doc_id long, item_id long, bm25_share double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document row and leaked item."""
    spark, out = docs.sparkSession, None
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [
                    (doc, index.items[item][0], *figures)
                    for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())
                    for item, figures in index.leaks(text).items()
                ]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _LEAK.split(", ")])

        found = own.mapInArrow(run, _LEAK)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _LEAK)


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak of any item, all columns unchanged."""
    spark, out = docs.sparkSession, docs
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(texts):
            import pandas as pd

            return pd.Series([not shared.value.leaks(t) for t in texts], dtype=bool)

        out = out.where(clean(F.col("text").cast("string")))
    return out
