"""Near-duplicate groups against brute force, and defined edge cases."""

import random

import corpus_pipeline
import numpy as np
import pytest

from cartulary.llm.neardup import NearDupSettings, keep_one, near_duplicates, plausible
from cartulary.llm.neardup_sketch import Signer, sketch_similarity

SCHEMA = "doc_id long, text string, class string, node string"


def _brute(rows):
    def shingle_set(text):
        words = (text or "").encode().lower().split()
        if not words:
            return frozenset()
        size = min(3, len(words))
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))

    sets = {doc: shingle_set(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 85 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 160))] for _ in range(12)]
    rows = [(0, ""), (1, None), (2, "one"), (3, "ONE"), (4, "one two")]
    for number in range(5, 150):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2, 4))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((number, " ".join(words)))
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in near_duplicates(frame).collect()]
    assert len(found) == len(rows) and set(found) == _brute(rows)


def test_empty_and_null(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", None, None), (7, "a b c d", None, None), (7, "a b c d", None, None)]
    found = sorted((str(r[0]), r[2]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [("7", 7), ("7", 7), ("None", None)]


@pytest.mark.parametrize("settings", [NearDupSettings(), corpus_pipeline.NEAR])
def test_links_with_low_sketches_stay(settings):
    random, signer, low = np.random.default_rng(1), Signer(settings.bands, settings.rows, settings.sketch_bits), 0
    for _ in range(1500):  # sets of 200 of which the share is common
        common = -(-2 * 200 * settings.share // (100 + settings.share))
        items = random.integers(0, 2**64, 400 - common, np.uint64)
        samples = [signer.samples(np.sort(part)) for part in (items[:200], items[200 - common :])]
        marks = np.stack([np.frombuffer(signer.sketch(x), np.uint64) for x in samples])
        bands = np.stack([signer.keys(x) for x in samples])
        differing = np.bitwise_count(marks[0] ^ marks[1]).sum()
        shared = np.flatnonzero(bands[0] == bands[1])
        if len(shared) and sketch_similarity(differing, settings.bands * settings.rows, settings.sketch_bits) < settings.share / 100 - 0.08:
            low += 1
            for nth, band in enumerate(shared.tolist()):
                found = plausible(0, np.array([1]), np.array([200, 200]), marks, bands, settings, int(bands[0][band]))
                assert found.tolist() == ([1] if nth == 0 else [])
    assert low > 1


def test_blocks_find_the_links_of_open_buckets(spark):
    """Texts around a centre that link to a neighbour and not to the pivot, in blocks of a few members."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for number in range(80):
        text = list(text)
        text[rng.randrange(120)] = rng.choice(words)
        text[rng.randrange(120)] = rng.choice(words)
        rows.append((number * 7 % 80, " ".join(text)))
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    for block in (3, 2048):
        assert {tuple(r) for r in near_duplicates(frame, NearDupSettings(block=block)).collect()} == _brute(rows)


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "o p q r s t u"), (2, "o p q r s t u"), (9, "A b c d e f g"), (None, "h i j k l m n"), (None, "x y z x y z w"), (None, ""), (5, None)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    kept = keep_one(docs, corpus_pipeline.NEAR)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "o p q r s t u"), (None, "x y z x y z w"), (None, ""), (5, None)], key=str)
    assert keep_one(docs.limit(0), corpus_pipeline.NEAR).count() == 0
