"""Repeated windows against SQL and a plain scan; the automaton against substring search."""

import hashlib
import random

import pytest

from cartulary.llm import automata
from cartulary.llm.automata import SuffixAutomaton, Windows
from tests.oracle import compare, connect, spark_bag, sql_bag


def _brute(rows, length):
    """``rows`` in the order in which they count as earlier."""
    seen, out = set(), []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - length + 1):
            run = tuple(words[at : at + length])
            if run in seen:
                gone[at : at + length] = [True] * length
            seen.add(run)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _found(spark, rows, windows):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, words string, tag int").repartition(5)
    return sorted((tuple(r) for r in automata.remove_repeated_windows(frame, windows).collect()), key=str)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    result = spark_bag(automata.remove_repeated_windows(spark.read.parquet(f"{folder}/documents.parquet")))
    assert compare(result, sql_bag(connect(folder), automata.ORACLE)) is None


@pytest.mark.parametrize("windows, seed", [(Windows(6, 3, 2048), 1), (Windows(6, 3, 2), 2), (Windows(5, 5, 3), 3), (Windows(7, 1, 1), 4)])
def test_equals_plain_scan(spark, windows, seed):
    """Small and large vocabularies, shards of any size, anchors that are settled window by window."""
    random.seed(seed)
    texts = [" ".join(random.choice("abc" if i % 3 else "abcdefghij") for _ in range(random.randint(0, 60))) for i in range(90)]
    passage = " ".join(f"p{i}" for i in range(12))
    texts += [f"x{i} y{i} {passage} z{i} w{i % 4}" for i in range(40)]
    texts += ["q " * 50, "", "\t\x0b one two \x0c three\r\n", "é ü 😀 " * 8]
    rows = list(enumerate(texts))
    assert _found(spark, rows, windows) == _brute(rows, windows.length)


def test_nulls_repeated_ids_and_rows(spark):
    windows = Windows(4, 2, 4)
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x a b c d e"), (3, None), (3, ""), (4, "a b"), (4, "a b"), (5, long), (9, long)]
    found = _found(spark, rows + [(None, "p q r s"), (None, "p q r s"), (8, "p q r s t")], windows)
    assert found == _brute(rows + [(8, "p q r s t"), (None, "p q r s"), (None, "p q r s")], 4)
    two = sorted(r[2] for r in _found(spark, [(1, "a b c d e"), (1, "b c d e f")], windows))
    assert two == [0, 4]  # one of them comes first, by digest
    assert _found(spark, [], windows) == []


def test_automaton_finds_every_substring():
    random.seed(7)
    for _ in range(60):
        held = [[random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 14))] for _ in range(4)]
        automaton = SuffixAutomaton()
        for words in held:
            automaton.add(words)
        known = {tuple(w[i:j]) for w in held for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        asked = [random.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        for end, length in enumerate(automaton.matching(asked)):
            longest = next((n for n in range(end + 1, 0, -1) if tuple(asked[end + 1 - n : end + 1]) in known), 0)
            assert length == longest
        assert len(automaton.links) <= 2 * sum(map(len, held)) + 1


def test_broadcast_references(spark, monkeypatch):
    reference = spark.createDataFrame([("a b c d e",), ("k l m n o p",), (None,), ("",)], "text string")
    docs = spark.createDataFrame([(1, "x a b c d y k l m n o z"), (2, "a b c x d e"), (None, "a b c d e"), (4, None)], "doc_id long, text string")
    for words in (200_000, 1):
        found = sorted(((r["doc_id"], r["first"], r["n"]) for r in automata.matched(docs, reference, 4, words).collect()), key=str)
        assert found == sorted([(1, 1, 4), (1, 6, 5), (None, 0, 5)], key=str)
    monkeypatch.setattr(automata, "REFERENCE_BYTES", 5)
    with pytest.raises(ValueError, match="broadcast"):
        automata.matched(docs, reference, 4)
