"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

from cartulary.llm.suffix import Parsing, remove_repeats, without_repeats

SCHEMA = "doc_id long, text string, kept int, packed int"


def _brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc, _), text in zip(rows, texts):
        covered = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(text, covered) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[(doc, len(text), sum(covered), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(("alpha", "bé", "gamma", "dx", "e")) + str(rng.randint(0, 99)) for _ in range(n))
    shared = [words(rng.randint(60, 140)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a" * 900), (3, "ab" * 700), (4, "x" * 399), (5, words(200)), (5, "short"), (None, shared[0])]
    for number in range(6, 50):
        parts = [words(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(shared)
            cut = rng.randint(0, len(text) // 3)
            parts += [text[cut : len(text) - rng.randint(0, len(text) // 3)], words(rng.randint(0, 3))]
        rows.append((number, "".join(parts)))
    rows.append(rows[20])
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA).repartition(4)
    for length in (400, 200):
        found = Counter(tuple(r) for r in remove_repeats(frame, Parsing(length=length)).collect())
        assert found == _brute(rows, length)
    kept = without_repeats(frame, Parsing(length=200))
    assert kept.columns == frame.columns and kept.count() == len(rows)
    assert kept.where("text is null").count() == 1 and kept.where("kept = 1 and packed = 2").count() == len(rows)
    again = Counter(r["text"][i : i + 200] for r in kept.collect() if r["text"] for i in range(len(r["text"]) - 199))
    assert sum(len(r["text"] or "") for r in kept.collect()) < sum(len(t or "") for _, t in rows) and again
    assert remove_repeats(frame.limit(0)).count() == without_repeats(frame.limit(0), Parsing()).count() == 0


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(6)
    words = lambda n: [rng.choice(("alpha", "bé", "g", "d", "e")) + str(rng.randint(0, 99)) for _ in range(n)]
    shared = [words(rng.randint(8, 60)) for _ in range(6)]
    texts = [None, "", "a " * 70, "a b " * 40, "\t one\n two  three\x0b"]
    for _ in range(60):
        parts = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(shared)
            cut = rng.randint(0, len(own) // 3)
            parts += own[cut : len(own) - rng.randint(0, len(own) // 3)] + words(rng.randint(0, 3))
        texts.append("".join(w + rng.choice((" ", "  ", "\n")) for w in parts))
    frame = spark.createDataFrame([(n, t, 1, 2) for n, t in enumerate(texts)], SCHEMA).repartition(4)
    for length, trigger in ((12, 4), (5, 1)):
        parsing = Parsing(length=length, trigger=trigger, step=4, words=True)
        split = [(t or "").split() for t in texts]
        counts = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
        found = {r["doc_id"]: r["text"] for r in without_repeats(frame, parsing).collect()}
        for number, own in enumerate(split):
            gone = [False] * len(own)
            for i in range(len(own) - length + 1):
                if counts[tuple(own[i : i + length])] > 1:
                    gone[i : i + length] = [True] * length
            assert (found[number] or "").split() == [w for w, g in zip(own, gone) if not g]
        assert found[0] is None
