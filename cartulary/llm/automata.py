"""Repeated word windows by suffix automata of reference shards.

A window of ``length`` words chooses an anchor: the least hash among its own runs of ``gram`` words, the leftmost of
equals. Equal windows choose the same one, so windows only need to meet where their anchors agree. Neighbouring windows
of one anchor form a segment; no window is in two segments.

1. Segments meet by anchor, as 64-bit hashes of their words: equal ones become one reference, at its earliest place;
   all later places lose every window. An anchor with one reference is done.
2. Other references get their words back from their texts.
3. They are dealt to shards by anchor. A shard's automaton holds the references of earlier places while the next
   one streams through it for its matching statistics: a match of ``length`` words or more at a word ends a window that
   starts earlier. Automata are built where references of the same anchors are, since a broadcast of all of them would
   grow with the input, and every document would meet every shard.
4. An anchor with more than ``shard`` references, as around a passage in a third of all texts, is settled window by
   window: equal windows are counted with their earliest place, which combines before the shuffle.
5. Maximal spans of matched words leave their documents.

``matched`` applies broadcast automata of a bounded reference table instead, and is what a given list of texts needs.

Defined cases: null texts have no words, and fewer words than ``length`` lose none; a null ``doc_id`` comes after all
ids; rows that repeat an id follow each other by a digest of their texts, and of rows that also repeat the text the
first one counts as earlier; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.words import WORDS, span_hashes, word_codes
from cartulary.session import settle

_NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Windows:
    """``shard``: references a shard holds about, and an anchor at most; an automaton has two states a word."""

    length: int = 20
    gram: int = 4
    shard: int = 2048


class SuffixAutomaton:
    """Suffix automaton of several word sequences, extended one after the other."""

    def __init__(self) -> None:
        self.steps: list[dict[bytes, int]] = [{}]
        self.links = [-1]
        self.lengths = [0]

    def _state(self, steps: dict[bytes, int], link: int, length: int) -> int:
        self.steps.append(steps)
        self.links.append(link)
        self.lengths.append(length)
        return len(self.links) - 1

    def _split(self, state: int, word: bytes, onto: int) -> int:
        """The state for ``state`` followed by ``word`` with exactly one word more; a copy of ``onto`` where it holds longer ones."""
        steps, links, lengths = self.steps, self.links, self.lengths
        if lengths[onto] == lengths[state] + 1:
            return onto
        copy = self._state(dict(steps[onto]), links[onto], lengths[state] + 1)
        links[onto] = copy
        while state >= 0 and steps[state].get(word) == onto:
            steps[state][word] = copy
            state = links[state]
        return copy

    def add(self, words: Iterable[bytes]) -> None:
        steps, links, lengths = self.steps, self.links, self.lengths
        last = 0
        for word in words:
            known = steps[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                continue
            fresh = self._state({}, 0, lengths[last] + 1)
            state = last
            while state >= 0 and word not in steps[state]:
                steps[state][word] = fresh
                state = links[state]
            if state >= 0:
                links[fresh] = self._split(state, word, steps[state][word])
            last = fresh

    def matching(self, words: Iterable[bytes]) -> Iterator[int]:
        """After each word, the length of the longest match that ends there."""
        steps, links, lengths = self.steps, self.links, self.lengths
        state = length = 0
        for word in words:
            while state and word not in steps[state]:
                state = links[state]
                length = lengths[state]
            onto = steps[state].get(word)
            if onto is None:
                length = 0
            else:
                state, length = onto, length + 1
            yield length


def segments(codes: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash of the words, first window and number of windows of each segment of one text."""
    total = len(codes) - windows.length + 1
    if total <= 0:
        return (np.empty(0, np.int64),) * 4
    places = np.arange(len(codes) - windows.gram + 1)
    grams = span_hashes(codes, places, places + windows.gram, WORDS)
    # leftmost least of ``reach`` neighbours, by doubling
    reach, best, width = windows.length - windows.gram + 1, places, 1
    while width < reach:
        shift = min(width, reach - width)
        left, right = best[: len(best) - shift], best[shift:]
        best = np.where(grams[right] < grams[left], right, left)
        width += shift
    firsts = np.flatnonzero(np.diff(best, prepend=-1))
    counts = np.diff(firsts, append=total)
    contents = span_hashes(codes, firsts, firsts + counts + windows.length - 1, WORDS)
    return grams[best[firsts]].view(np.int64), contents.view(np.int64), firsts, counts


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): the text as bytes and a digest of it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed, so that they move cheaply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress(t.as_buffer()) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], packed], ["doc_id", "tag", "packed"])

    return texts.mapInArrow(run, "doc_id long, tag long, packed binary")


_FACTS = "doc_id long, tag long, n_words long, digest string, anchor array<long>, content array<long>, first array<long>, n array<long>"


def _facts(texts: DataFrame, windows: Windows) -> DataFrame:
    """Number of words, digest of all words and segments of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, digests, found = [], [], []
                for text in part["text"]:
                    text = text.as_py()
                    words = text.split()
                    counts.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    found.append(segments(word_codes(text), windows))
                columns = [part["doc_id"], part["tag"], pa.array(counts, pa.int64()), pa.array(digests), *map(_lists, zip(*found))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _FACTS.split(", ")])

    return texts.mapInArrow(run, _FACTS)


def _lists(rows: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


#: Anchors with more than this share of a sample's segments are counted before they are shuffled.
_HOT_SHARE = 200
_SAMPLED = 64


def _place() -> Column:
    """Segments in the order in which their windows count as earlier."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tag", "first")


def _judged(facts: DataFrame) -> DataFrame:
    """(doc_id, tag, later, refs): per text, segments whose words start earlier, and earliest ones whose anchor has other words too.

    Segments meet by anchor in one shuffle. Anchors that a sample shows to be hot (``_HOT_SHARE`` at most) take another
    way to the same rows: counts that combine before the shuffle, and a join that adaptive execution splits.
    """
    spread = facts.select("doc_id", "tag", F.explode(F.arrays_zip("anchor", "content", "first", "n")).alias("s"))
    every = spread.select("doc_id", "tag", "s.anchor", "s.content", "s.first", "s.n").withColumn("place", _place())
    sample = facts.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(_SAMPLED)) == 0).select(F.explode("anchor").alias("anchor"))
    total = sample.count()
    hot = F.broadcast(sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") * _HOT_SHARE > max(total, 5 * _HOT_SHARE)).select("anchor"))

    cold = every.join(hot, "anchor", "left_anti")
    within = Window.partitionBy("anchor", "content").orderBy("place")
    whole = Window.partitionBy("anchor").orderBy("content").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cold = cold.withColumn("rank", F.rank().over(within)).withColumn("several", F.first("content").over(whole) != F.last("content").over(whole))
    cold = cold.select("doc_id", "tag", "anchor", "first", "n", (F.col("rank") > 1).alias("later"), "several")

    warm = every.join(hot, "anchor", "left_semi")
    earliest = warm.groupBy("anchor", "content").agg(F.min("place").alias("earliest"))
    several = earliest.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"))
    warm = warm.join(earliest.join(several, "anchor"), ["anchor", "content"])
    warm = warm.select("doc_id", "tag", "anchor", "first", "n", (F.col("place") != F.col("earliest")).alias("later"), "several")

    kept = cold.unionByName(warm).where("later or several")
    return kept.groupBy("doc_id", "tag").agg(
        F.collect_set(F.when(F.col("later"), F.struct("first", "n"))).alias("later"),
        F.collect_set(F.when(~F.col("later"), F.struct("anchor", "first", "n"))).alias("refs"),
    )


def _same_text(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.tag") == F.col(f"{right}.tag"))


_REFERENCE = "anchor long, doc_id long, tag long, first long, words binary"


def _references(wanted: DataFrame, windows: Windows) -> DataFrame:
    """The words of the ``refs`` beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, tag, packed, refs in zip(*(batch[c] for c in ("doc_id", "tag", "packed", "refs"))):
                words, refs = unpack.decompress(packed.as_py()).split(), refs.values
                firsts, counts = (refs.field(c).to_pylist() for c in ("first", "n"))
                pieces = [b" ".join(words[f : f + n + windows.length - 1]) for f, n in zip(firsts, counts)]
                columns = [refs.field("anchor"), pa.array([doc.as_py()] * len(refs), pa.int64()), pa.array([tag.as_py()] * len(refs), pa.int64()), refs.field("first"), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _REFERENCE.split(", ")])

    return wanted.select("doc_id", "tag", "packed", "refs").mapInArrow(run, _REFERENCE)


_MASK = "doc_id long, tag long, first long, mask long"


def _streamed(references: DataFrame, windows: Windows) -> DataFrame:
    """Windows of each reference that an earlier reference of its shard holds, as a bitmap."""

    def run(table: pa.Table) -> pa.Table:
        places = list(zip(*(table[c].to_pylist() for c in ("doc_id", "tag", "first"))))
        order = sorted(range(len(places)), key=lambda i: (places[i][0] is None, places[i][0] or 0, *places[i][1:]))
        automaton, words, before, out = SuffixAutomaton(), table["words"], None, []
        for row in order:
            if places[row] == before:  # the same row of a repeated text
                continue
            before, own, mask = places[row], words[row].as_py().split(b" "), 0
            for end, length in enumerate(automaton.matching(own)):
                if length >= windows.length:
                    mask |= 1 << (end - windows.length + 1)
            automaton.add(own)
            if mask:
                out.append((*before, mask))
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "tag", "first", "mask"])

    return references.groupBy("shard").applyInArrow(run, _MASK)


def _window_by_window(references: DataFrame, windows: Windows) -> DataFrame:
    """The same bitmaps for anchors of any number of references, from the earliest place of each window."""
    kind = "doc_id long, tag long, base long, bit int, window binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bits, digests = [], [], []
            for row, text in enumerate(batch["words"]):
                words = text.as_py().split(b" ")
                for bit in range(len(words) - windows.length + 1):
                    rows.append(row)
                    bits.append(bit)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words[bit : bit + windows.length])))
            own = batch.select(["doc_id", "tag", "first"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], [f.split()[0] for f in kind.split(", ")])

    every = settle(references.select("doc_id", "tag", "first", "words").mapInArrow(run, kind))
    every = every.withColumn("first", F.col("base") + F.col("bit")).withColumn("place", _place())
    earliest = every.groupBy("window").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = every.join(earliest, "window").where(F.col("place") > F.col("earliest"))
    return later.groupBy("doc_id", "tag", F.col("base").alias("first")).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def _masks(references: DataFrame, windows: Windows) -> DataFrame:
    found = settle(references)
    sizes = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"))
    sized = found.join(sizes, "anchor")
    shards = max(1, found.count() // windows.shard)
    dealt = sized.where(F.col("size") <= windows.shard).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return _streamed(dealt, windows).unionByName(_window_by_window(sized.where(F.col("size") > windows.shard), windows))


def _without(hit: DataFrame, windows: Windows) -> DataFrame:
    """(doc_id, tag, n_removed, kept): texts without the segments and windows listed beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, kept = [], []
            for packed, later, masks in zip(batch["packed"], batch["later"], batch["masks"]):
                words = unpack.decompress(packed.as_py()).split()
                edges = np.zeros(len(words) + 1, np.int64)
                firsts, counts = (later.values.field(c).to_numpy() for c in ("first", "n"))
                np.add.at(edges, firsts, 1)
                np.add.at(edges, firsts + counts + windows.length - 1, -1)
                if masks.is_valid:
                    firsts, bits = (masks.values.field(c).to_numpy() for c in ("first", "mask"))
                    for bit in range(windows.length - windows.gram + 1):
                        starts = firsts[(bits >> bit) & 1 == 1] + bit
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, starts + windows.length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(itertools.compress(words, (~gone).tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "tag", "n_removed", "kept"])

    return hit.select("doc_id", "tag", "packed", "later", "masks").mapInArrow(run, "doc_id long, tag long, n_removed long, kept string")


def remove_repeated_windows(docs: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs(doc_id, text)``."""
    texts = _texts(docs)
    facts, packed = settle(_facts(texts, windows)), _packed(texts)
    judged = settle(_judged(facts))
    asked = packed.alias("t").join(judged.where(F.size("refs") > 0).alias("j"), _same_text("t", "j"))
    masks = _masks(_references(asked.select("t.doc_id", "t.tag", "packed", "refs"), windows), windows)
    masks = masks.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "mask")).alias("masks"))
    lost = judged.alias("j").join(masks.alias("m"), _same_text("j", "m"), "left").where("size(later) > 0 or masks is not null")
    hit = packed.alias("t").join(lost.select("j.doc_id", "j.tag", "later", "masks").alias("l"), _same_text("t", "l"))
    changed = _without(hit.select("t.doc_id", "t.tag", "packed", "later", "masks"), windows).dropDuplicates(["doc_id", "tag"])
    once = facts.groupBy("doc_id", "tag").agg(F.first("n_words").alias("n_words"), F.first("digest").alias("digest"), F.count(F.lit(1)).alias("copies"))
    first = once.alias("o").join(changed.alias("c"), _same_text("o", "c"), "left").select(
        "o.doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "digest").alias("kept_sha256")
    )
    more = once.where("copies > 1").select("doc_id", "n_words", "digest", F.explode(F.sequence(F.lit(2).cast("long"), "copies")))
    gone = F.col("n_words") >= windows.length
    rest = more.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(gone, F.lit(_NOTHING)).otherwise(F.col("digest")).alias("kept_sha256"))
    return first.unionByName(rest)


#: Bytes of reference text that may be broadcast.
REFERENCE_BYTES = 64 << 20


def matched(docs: DataFrame, reference: DataFrame, length: int = 20, shard_words: int = 200_000) -> DataFrame:
    """(doc_id, first, n): maximal word spans of ``docs`` covered by runs of ``length`` words that ``reference(text)`` holds.

    The reference is broadcast as automata of ``shard_words`` words each and may have ``REFERENCE_BYTES`` at most; more is
    an error. Every row of ``docs`` streams through all of them.
    """
    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > REFERENCE_BYTES:
        raise ValueError(f"the reference has {size} bytes, more than the {REFERENCE_BYTES} that may be broadcast")
    shards: list[list[list[bytes]]] = [[]]
    room = shard_words
    for row in reference.where("text is not null").select(F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = bytes(row["text"]).split()
        if len(words) > room and shards[-1]:
            shards.append([])
            room = shard_words
        shards[-1].append(words)
        room -= len(words)
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in sent.value:
            automata.append(SuffixAutomaton())
            for words in shard:
                automata[-1].add(words)
        for batch in batches:
            out: list[list[int | None]] = [[], [], []]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = (text or b"").split()
                edges = np.zeros(len(words) + 1, np.int64)
                for automaton in automata:
                    ends = np.array([e for e, found in enumerate(automaton.matching(words)) if found >= length], np.int64)
                    np.add.at(edges, ends - length + 1, 1)
                    np.add.at(edges, ends + 1, -1)
                turns = np.diff((np.cumsum(edges[:-1]) > 0).astype(np.int8), prepend=0, append=0)
                for first, end in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()):
                    for column, x in zip(out, (doc, first, end - first)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "first", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, first long, n long"
    )


ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, first, array_to_string(words[first:first + 19], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS first FROM split)
), later AS (
  SELECT doc_id, first FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, first) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, first + 20)) AS place FROM later
), flat AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.place) AS n_removed, string_agg(word, ' ' ORDER BY f.place) FILTER (WHERE g.place IS NULL) AS kept
  FROM flat f LEFT JOIN gone g USING (doc_id, place) GROUP BY doc_id
)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""
