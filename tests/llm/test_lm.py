"""Unigram figures against brute force; the model is normalised and beats the unigram on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np

from cartulary.llm import lm
from cartulary.llm.lbl import CLASSES, log10_table, start

FOLDER = "/root/testdata/sf0.01"


def _brute(rows):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, (_, t) in enumerate(rows)}
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for i, (d, _) in enumerate(rows)}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    floor = math.log10(total + 0.1 * (kinds + 1))
    return sorted(
        (str(d), held[i], len(tokens[i]), sum(w in counts for w in tokens[i]), total, round(sum(math.log10(counts[w] + 0.1) - floor for w in tokens[i]), 5))
        for i, (d, _) in enumerate(rows)
    )


def _found(frame):
    return sorted((str(r[0]), *r[1:5], round(r["base_score"], 5)) for r in frame.collect())


def test_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for head in (lm.HEAD, 300):
        monkeypatch.setattr(lm, "HEAD", head)
        found = lm.language_scores(docs).cache()
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert [x[:5] for x in _found(found)] == [x[:5] for x in _brute(rows)]
        assert max(abs(a[5] - b[5]) for a, b in zip(_found(found), _brute(rows))) < 1e-3
        held = found.where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
        assert held["sum(score)"] > held["sum(base_score)"] + 0.05 * held["sum(n_tokens)"]


def test_table_is_normalised():
    table = log10_table(start(np.full(CLASSES, 1 / CLASSES)))
    assert np.abs((10.0 ** table.astype(float)).sum(axis=1) - 1).max() < 1e-4


def test_odd_rows(spark):
    schema = "doc_id long, text string, n long, score string"
    rows = [(None, "a b a"), (1, None), (1, ""), (2, "A b c \x1c d"), (2, "x " * 50_000), (20, "zz zz")]
    frame = spark.createDataFrame([(d, t, 5, "s") for d, t in rows], schema).repartition(3)
    assert [x[:5] for x in _found(lm.language_scores(frame))] == [x[:5] for x in _brute(rows)]
    assert lm.language_scores(frame.limit(0)).count() == 0
