"""Language-model scores of whole texts, beside the smoothed unigram of the same training tokens.

Tokens are counted over all training texts by their 64-bit digest. Tokens at or above a count that at most ``HEAD`` of them
reach go to every task; the others meet their counts by a join, where no key is frequent. The log-bilinear model
(see ``lbl``) learns from every training text: each task trains on its rows and the parameters are averaged by the
tokens seen, after a short first round and again after the whole one. A token's probability is that of its class in
context times its smoothed share of the class, so both sum to one over known tokens and one unknown a shared class.

Defined cases: null texts are empty and are their end token alone; a null ``doc_id`` is not held out; repeated rows count
and are scored each; without training texts all tokens are unknown; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.lbl import CLASSES, OWN, PARAMETERS, Trainer, WordShapes, log10_table, shape_of, start
from cartulary.llm.words import words_in
from cartulary.session import settle

HEAD = 65_536
SMOOTHING = 0.1
WARM_BATCHES = 60


@dataclass(frozen=True)
class Counts:
    """What every task knows: totals, frequent tokens by digest, and per class the smoothed total."""

    tokens: int
    kinds: int
    digests: np.ndarray
    counts: np.ndarray
    own_class: np.ndarray
    class_log: np.ndarray
    shares: np.ndarray


#: Digest and shared class of the end that follows a text's words.
END, END_SHAPE = 0, shape_of(b"")


class Reader:
    """Digests and shared classes of the tokens of texts, many texts at once."""

    def __init__(self) -> None:
        self.shapes = WordShapes()

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests, shapes, tokens of each text), texts one after the other."""
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        joined = b" ".join(parts)
        codes, starts, ends = words_in(joined)
        before = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        sizes = np.diff(before) + 1
        ending = np.cumsum(sizes) - 1
        inside = np.ones(len(codes) + len(parts), bool)
        inside[ending] = False
        digests, shapes = np.full(len(inside), END, np.int64), np.full(len(inside), END_SHAPE, np.uint8)
        digests[inside] = codes.view(np.int64)
        shapes[inside] = self.shapes.of(np.frombuffer(joined, np.uint8), starts, ends)
        return digests, shapes, sizes


def _own(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))


def token_counts(training: DataFrame) -> DataFrame:
    """(digest, shape, n) of all tokens of ``training(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                digests, shapes, _ = reader.read(batch.slice(at, 4000)["text"].to_pylist())
                found, first, n = np.unique(digests, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(shapes[first].astype(np.int32)), pa.array(n)], ["digest", "shape", "n"])

    rows = training.select("text").mapInArrow(run, "digest long, shape int, n long")
    return settle(rows.groupBy("digest", "shape").agg(F.sum("n").alias("n")))


def summarise(counts: DataFrame) -> Counts:
    """Totals, the frequent tokens (at most ``HEAD``) and the classes' totals; bounded whatever the corpus."""
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()
    power = F.floor(F.log2("n")).cast("int")
    above, least = 0, 63
    for row in sorted(counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["p"]):
        above += row["n"]
        if above > HEAD:
            break
        least = row["p"]
    frequent = counts.where(power >= least).select("digest", "n").collect()
    frequent.sort(key=lambda r: (-r["n"], r["digest"]))
    single = {r["digest"] for r in frequent[:OWN]}
    digests = np.array([r["digest"] for r in frequent], np.int64)
    values = np.array([r["n"] for r in frequent], np.int64)
    own = np.full(len(frequent), -1, np.int64)
    own[: min(OWN, len(frequent))] = np.arange(min(OWN, len(frequent)))
    order = np.argsort(digests)
    sums = np.zeros(CLASSES)
    sums[: min(OWN, len(frequent))] = values[:OWN] + SMOOTHING
    weight = np.zeros(CLASSES)
    weight[:OWN] = np.where(sums[:OWN] > 0, sums[:OWN], SMOOTHING)
    kept = counts.where(~F.col("digest").isin(*single)) if single else counts
    sums[OWN:] = SMOOTHING
    for row in kept.groupBy("shape").agg(F.sum(F.col("n") + SMOOTHING).alias("n")).collect():
        sums[row["shape"]] += row["n"]
    shares = np.maximum(sums, SMOOTHING)
    sums[:OWN] = weight[:OWN]
    return Counts(
        total["tokens"] or 0, total["kinds"], digests[order], values[order], own[order], np.log10(sums), shares / shares.sum()
    )


def _classes(counts: Counts, digests: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each token, whether it is frequent, its place among the frequent)."""
    if not len(counts.digests):
        return shapes, np.zeros(len(digests), bool), np.zeros(len(digests), np.int64)
    at = np.minimum(np.searchsorted(counts.digests, digests), len(counts.digests) - 1)
    frequent = counts.digests[at] == digests
    own = np.where(frequent, counts.own_class[at], -1)
    return np.where(own >= 0, own, shapes).astype(np.uint8), frequent, at


def _contexts(classes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the token before and the one before that; ends stand before a text's first token."""
    starts = np.cumsum(sizes) - sizes
    first = np.concatenate(([end], classes[:-1])).astype(np.uint8)
    first[starts] = end
    second = np.concatenate(([end], first[:-1])).astype(np.uint8)
    second[starts] = end
    return first, second


def _end_class(counts: Counts) -> int:
    return int(_classes(counts, np.array([END], np.int64), np.array([END_SHAPE], np.uint8))[0][0])


def train(training: DataFrame, counts: Counts) -> np.ndarray:
    """Parameters learnt from all rows; tasks' parameters are averaged in Spark, weighted by their tokens."""
    flat = start(counts.shares)
    if not counts.tokens:
        return flat
    for whole in (False, True):

        def run(batches: Iterator[pa.RecordBatch], flat=flat, whole=whole) -> Iterator[pa.RecordBatch]:
            reader, seen = Reader(), 0
            trainer = Trainer(flat, counts.shares, part=TaskContext.get().partitionId())
            end = _end_class(counts)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    if not whole and trainer.turn >= WARM_BATCHES:
                        break
                    digests, shapes, sizes = reader.read(batch.slice(at, 1000)["text"].to_pylist())
                    classes, _, _ = _classes(counts, digests, shapes)
                    trainer.learn(classes, *_contexts(classes, sizes, end))
                    seen += len(classes)
            if seen:
                weighted = trainer.flat.astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(PARAMETERS + 1, dtype=np.int32)), pa.array(np.append(weighted, float(seen)))], ["place", "value"]
                )

        rows = training.select("text").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        summed = np.zeros(PARAMETERS + 1)
        for row in rows:
            summed[row["place"]] = row["value"]
        flat = (summed[:-1] / summed[-1]).astype(np.float32)
    return flat


_TABLES: dict[bytes, np.ndarray] = {}


def _table(flat: np.ndarray) -> np.ndarray:
    """The normalised table of a model, made once in each worker."""
    key = flat.tobytes()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = log10_table(flat)
    return _TABLES[key]


_READ = "row_key long, doc_id long, held_out boolean, n_tokens long, known long, unigram double, model double, rare array<struct<digest:long,times:int>>"
_RARE = pa.list_(pa.struct([("digest", pa.int64()), ("times", pa.int32())]))


def _read(own: DataFrame, counts: Counts, flat: np.ndarray) -> DataFrame:
    """Per row: sums over frequent tokens, the model's sum without the tokens' own counts, and the rare tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, nth, part = Reader(), 0, TaskContext.get().partitionId()
        table, end = _table(flat), _end_class(counts)
        logs = np.log10(counts.counts + SMOOTHING) if len(counts.counts) else np.zeros(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                block = batch.slice(at, 1000)
                digests, shapes, sizes = reader.read(block["text"].to_pylist())
                classes, frequent, place = _classes(counts, digests, shapes)
                first, second = _contexts(classes, sizes, end)
                starts = np.cumsum(sizes) - sizes
                token = table[first.astype(np.int64) * CLASSES + second, classes].astype(np.float64) - counts.class_log[classes]
                known = np.add.reduceat(frequent.astype(np.int64), starts)
                unigram = np.add.reduceat(np.where(frequent, logs[np.where(frequent, place, 0)], 0.0), starts)
                rows = np.repeat(np.arange(len(sizes)), sizes)[~frequent]
                # a text's rare tokens once each, with how often
                order = np.lexsort((digests[~frequent], rows))
                rows, rare = rows[order], digests[~frequent][order]
                change = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (rare[1:] != rare[:-1]))) if len(rows) else np.empty(0, bool))
                times = np.diff(np.append(change, len(rows))).astype(np.int32)
                offsets = np.searchsorted(rows[change] if len(change) else np.empty(0, np.int64), np.arange(len(sizes) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(rare[change] if len(change) else np.empty(0, np.int64)), pa.array(times)], ["digest", "times"])
                keys = np.arange(nth, nth + len(sizes)) + (part << 40)
                nth += len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), block["doc_id"], block["held_out"], pa.array(sizes), pa.array(known), pa.array(unigram), pa.array(np.add.reduceat(token, starts)),
                     pa.ListArray.from_arrays(pa.array(offsets), values).cast(_RARE)],
                    ["row_key", "doc_id", "held_out", "n_tokens", "known", "unigram", "model", "rare"],
                )

    return settle(own.mapInArrow(run, _READ))


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    own = _own(docs)
    training = own.where(~F.col("held_out"))
    by_token = token_counts(training)
    counts = summarise(by_token)
    read = _read(own, counts, train(training, counts))
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTHING)
    rare = read.select("row_key", F.explode("rare").alias("r")).select("row_key", "r.digest", "r.times")
    met = rare.join(by_token.select("digest", "n"), "digest", "left").groupBy("row_key").agg(
        F.sum(F.col("times") * log).alias("rare_unigram"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    total = float(np.log10(counts.tokens + SMOOTHING * (counts.kinds + 1)))
    unigram = F.col("unigram") + F.coalesce("rare_unigram", F.lit(0.0))
    return read.drop("rare").join(met, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"), (unigram - F.col("n_tokens") * total).alias("base_score"), (unigram + F.col("model")).alias("score"),
    )
