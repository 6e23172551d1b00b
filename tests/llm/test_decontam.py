"""Leaks against brute force over all pairs of texts and items."""

import random

from cartulary.llm import decontam
from cartulary.llm.decontam import Index, OVERLAP, THRESHOLD, clean_rows, grams, leaks, question_and_answer, words

SCHEMA = "doc_id long, text string, item_id long, score string"


def _world():
    rng = random.Random(8)
    vocabulary = ["the", "of", "and", "to"] * 60 + [f"t{i}" for i in range(900)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize()
    items = [(i, f"{sentence(rng.randint(6, 60))}. {sentence(rng.randint(1, 12))}.") for i in range(40)]
    items += [(40, sentence(400)), (41, "Yes"), (42, items[3][1]), (43, None), (44, "...")]
    rows = []
    for number in range(120):
        parts = [sentence(rng.randint(0, 300))]
        if number % 3 == 0:
            text = rng.choice(items[:41])[1].split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                text[rng.randrange(len(text))] = "changed"
            parts += [" ".join(text), sentence(rng.randint(0, 150))]
        rows.append((number, " ".join(parts)))
    return items, rows + [(None, items[0][1]), (200, None), (201, "")]


def _brute(items, rows):
    def share(part, text):
        needed = grams(part)
        size = min(5, len(part))
        held = {tuple(text[i : i + size]) for i in range(len(text) - size + 1)}
        return len(needed & held) / len(needed) if needed else 1.0

    return {
        (doc, item) for doc, text in rows for item, source in items if source and words(source)
        if min(share(part, words(text)) for part in question_and_answer(source)) >= OVERLAP or share(words(source), words(text)) >= OVERLAP
    }


def test_leaks_equal_brute_force(spark):
    items, rows = _world()
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], SCHEMA).repartition(3)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks(docs, benchmark).collect()}
    expected = _brute(items, rows)
    assert found == expected and len(expected) > 20
    dirty = {d for d, _ in expected}
    assert {r["doc_id"] for r in clean_rows(docs, benchmark).collect()} == {d for d, _ in rows} - dirty
    assert leaks(docs.limit(0), benchmark).count() == leaks(docs, benchmark.limit(0)).count() == 0
    assert clean_rows(docs, benchmark.limit(0)).count() == len(rows)


def test_shards_find_the_same(spark, monkeypatch):
    items, rows = _world()
    monkeypatch.setattr(decontam, "SHARD", 15)
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], SCHEMA)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, benchmark).collect()} == _brute(items, rows)


def test_wand_equals_full_scoring():
    items, rows = _world()
    kept = [(i, t) for i, t in items if t and words(t)]
    frequency = {}
    for _, text in kept:
        for at in range(0, len(words(text)), 96):
            for w in set(words(text)[at : at + 96]):
                frequency[w] = frequency.get(w, 0) + 1
    index = Index(kept, len(kept) + 4, frequency, 40.0)
    for _, text in rows[:60]:
        query = sorted({index.ids[w] for w in words(text)[:192] if w in index.ids})
        totals = {}
        for w in query:
            for segment, weight in index.postings[w]:
                totals[segment] = totals.get(segment, 0.0) + weight
        assert sorted(index.wand(query)) == sorted(s for s, x in totals.items() if x >= THRESHOLD - 1e-9)


def test_near_copies_with_a_changed_last_sentence(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD", 15)
    items, rows = _world()
    rng, long = random.Random(1), [(i, t) for i, t in items if t and len(words(t)) > 40]
    for number, (_, text) in enumerate(long):
        copy = text.split()
        copy[-rng.randint(1, 3)] = "changed"
        rows.append((1000 + number, " ".join(copy)))

    expected = _brute(items, rows)
    assert len({d for d, _ in expected if d is not None and d >= 1000}) == len(long)
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], SCHEMA)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, benchmark).collect()} == expected
    dirty = {d for d, _ in expected}
    assert {r["doc_id"] for r in clean_rows(docs, benchmark).collect()} == {d for d, _ in rows} - dirty
