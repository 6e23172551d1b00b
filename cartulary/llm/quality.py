"""Quality scores by Bradley-Terry ranking of preference pairs, thresholded at a score quantile.

A labelled text of quality 1 is preferred to one of quality 0; a pair is won with probability
``sigmoid(s(better) - s(worse))``. The score is linear in the text's features, so the logistic loss sees only feature
differences. Features are hashed character patterns of words and shares of shapes, all relative to the text's length.

The model is fitted on the driver on at most ``sample`` labelled rows, those with the least hash of their id; everything
else covers all rows. The cut is the quantile of the training scores that leaves as large a share below it as there are
rows of quality 0; it maps to 0.7 on the scale from 0 to 1.

Defined cases: a null or empty text is scored like any other, from the features of the empty text; a null ``doc_id``
is not held out and never matches a label; repeated labels count once each; without labels of both kinds every score is
0.7, so nothing is rejected; columns other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.7
HASHED = 256
_SHAPES = 14
SIZE = HASHED + _SHAPES


@dataclass(frozen=True)
class RankingSettings:
    """``sample`` bounds the labelled rows that reach the driver; ``pairs`` is drawn per preferred row and pass."""

    sample: int = 6_000
    passes: int = 300
    decay: float = 1e-3
    rate: float = 0.5
    seed: int = 11


_SHAPE = bytes.maketrans(bytes(range(256)), bytes(
    0x61 if 97 <= b <= 122 else 0x41 if 65 <= b <= 90 else 0x39 if 48 <= b <= 57 else 0x20 if b in b" \t\n\r\x0b\x0c" else 0x75 if b >= 128 else b
    for b in range(256)
))
_RUNS = re.compile(rb"(.)\1*", re.S)


def features(text: str | None) -> np.ndarray:
    """Feature vector of a whole text: hashed word endings and shapes by their share, then shares of kinds of bytes,
    lines and repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(SIZE)
    words = data.split()
    count = max(1, len(words))
    kinds = Counter(words)
    shapes: Counter = Counter()
    for word, times in kinds.items():
        shapes[word[-2:].translate(_SHAPE) + (b"^" if word[:1].isupper() else b"")] += times
    for shape, times in shapes.items():
        out[zlib.crc32(shape) % HASHED] += (times / count) ** 0.5
    size = max(1, len(data))
    table = np.bincount(np.frombuffer(data.translate(_SHAPE), np.uint8), minlength=256) / size
    letters = table[0x61] + table[0x41] + table[0x75]
    lines = data.split(b"\n")
    most = max(kinds.values(), default=0)
    out[HASHED:] = (
        1.0, letters, table[0x41], table[0x39], table[0x20], 1.0 - letters - table[0x39] - table[0x20],
        len(kinds) / count, most / count, len(set(lines)) / len(lines), min(1.0, len(lines) / count),
        np.log1p(count) / 10.0, size / count / 20.0, float(count < 5),
        sum(t for w, t in kinds.items() if not any(c >= 128 or 48 <= c <= 57 or 65 <= (c & ~32) <= 90 for c in w)) / count,
    )
    return out


def fit(rows: np.ndarray, quality: np.ndarray, settings: RankingSettings = RankingSettings()) -> tuple[np.ndarray, float, float]:
    """(weights, cut, scale) from feature rows and labels 0 or 1."""
    better, worse = rows[quality == 1], rows[quality == 0]
    if not len(better) or not len(worse):
        return np.zeros(rows.shape[1] if rows.ndim == 2 else SIZE), 0.0, 1.0
    spread = rows.std(axis=0) + 1e-2
    random, weights = np.random.default_rng(settings.seed), np.zeros(rows.shape[1])
    step, drift = np.zeros_like(weights), np.zeros_like(weights)
    batch = 1024
    for turn in range(1, settings.passes + 1):
        pair = (better[random.integers(0, len(better), batch)] - worse[random.integers(0, len(worse), batch)]) / spread
        miss = 1.0 / (1.0 + np.exp(np.clip(pair @ weights, -30, 30)))
        slope = settings.decay * weights - miss @ pair / batch
        step = 0.9 * step + 0.1 * slope
        drift = 0.99 * drift + 0.01 * slope * slope
        weights -= settings.rate * 0.1 * (step / (1 - 0.9**turn)) / (np.sqrt(drift / (1 - 0.99**turn)) + 1e-8)
    weights = weights / spread
    scores = rows @ weights
    cut = float(np.quantile(scores, len(worse) / len(rows)))
    below, above = scores[scores < cut], scores[scores >= cut]
    if len(below) and len(above):  # between the neighbours of the quantile
        cut = float(below.max() + above.min()) / 2
    return weights, cut, float(scores.std() + 1e-9)


def to_unit(raw: np.ndarray, cut: float, scale: float) -> np.ndarray:
    """Monotone map to 0..1 with the cut at 0.7."""
    return 1.0 / (1.0 + np.exp(-np.clip((raw - cut) / scale, -30, 30)) * (1 - CUT) / CUT)


def training_rows(docs: DataFrame, labels: DataFrame, settings: RankingSettings) -> DataFrame:
    """The labelled rows that teach: not held out, at most ``sample``, by hash of the id."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("string").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    teach = known.where("pmod(crc32(cast(label_id as binary)), 4) <> 2")
    chosen = teach.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(settings.sample)
    own = docs.select(F.col("doc_id").cast("string").alias("label_id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(chosen), "label_id").select("text", "quality")


def learn(docs: DataFrame, labels: DataFrame, settings: RankingSettings = RankingSettings()) -> tuple[np.ndarray, float, float]:
    """Fit on the bounded sample; only feature vectors reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t).astype(np.float32).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), batch["quality"]], ["vector", "quality"])

    # repeated ids give a label several texts; the bound holds for them as well
    rows = training_rows(docs, labels, settings).mapInArrow(run, "vector binary, quality int")
    rows = rows.orderBy(F.xxhash64("vector"), "vector", "quality").limit(settings.sample).collect()
    vectors = np.array([np.frombuffer(r["vector"], np.float32) for r in rows], float).reshape(-1, SIZE)
    return fit(vectors, np.array([r["quality"] for r in rows], int), settings)


_SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    weights, cut, scale = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([features(t) @ weights for t in batch["text"].to_pylist()], float)
            found = to_unit(raw, cut, scale)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(found), pa.array((found >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(run, _SCORED)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: RankingSettings = RankingSettings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    return score(docs, learn(docs, labels, settings))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """The rows of ``docs`` whose score reaches the cut, all columns unchanged."""
    weights, cut, scale = model

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        return pd.Series(to_unit(np.array([features(t) @ weights for t in texts], float), cut, scale) >= CUT)

    return docs.where(good(F.col("text").cast("string")))
