"""Conversation tries against SQL and a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from cartulary.llm import trie
from tests.oracle import compare, connect, spark_bag, sql_bag

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def _rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def mark(item):
        return hashlib.md5(f"{len(item[2])}:{item[2]}{item[3]}".encode()).hexdigest()

    lists = {c: [(r, x) for *_, r, x in sorted(turns, key=lambda i: (i[:2], mark(i)))] for c, turns in own.items()}
    out = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = lists.get(c - c % 100, [])[:h] + turns[h:]
    return out


def _brute(rows):
    members, ends = {}, {}
    for c, turns in _rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node, own in sorted(members.items(), key=lambda i: -len(i[0])):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) or 1
        saved[node] = sum(saved[c] for c in below) + ((len(own) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (
            (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves[node], saved[node])
            + (hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),)
            for node, own in members.items()
        ),
        key=str,
    )


def _found(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in trie.conversation_trie(frame).collect()), key=str)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    result = spark_bag(trie.conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet")))
    assert compare(result, sql_bag(connect(folder), trie.ORACLE)) is None


@pytest.mark.parametrize("bits, seed", [(0, 1), (1, 2), (2, 3), (4, 4), (10, 5)])
def test_equals_prefixes(spark, monkeypatch, bits, seed):
    """Shards of one, two, four, sixteen and many sequences; shared, hot, long and empty conversations, ties and nulls."""
    monkeypatch.setattr(trie, "SHARD_BITS", bits)
    monkeypatch.setattr(trie, "ID_BLOCK_BITS", 3)
    random.seed(seed)
    words = ["", "a", "b", "café 😀"]
    rows = [(c, t, "user", random.choice(words)) for c in random.sample(range(420), 130) for t in range(random.randint(1, 6))]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(3)]  # a hot conversation
    rows += [(c, t, random.choice("ua"), "long") for c in (2000, 2001, 2002) for t in range(70)]
    rows += [(5000, None, "user", "null turn"), (5000, 1, None, None), (5000, 1, None, "tie"), (5000, 1, None, "tie"), (None, 1, "user", "x")]
    rows += [(c, 0, "user", "only") for c in (7001, 7002, 7003, 7004)]  # no first of the family
    assert _found(spark, rows) == _brute(rows)


def test_empty_and_lone(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(None, 1, "user", "x")]) == []
    assert _found(spark, [(0, 0, "user", "x")]) == _brute([(0, 0, "user", "x")])
    turnless = [(c, 0, "user", "only") for c in range(7001, 7099)]
    assert _found(spark, turnless) == _brute(turnless)


def test_end_lists_stream_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BLOCK_BITS", 2)
    ids = random.Random(3).sample(range(10_000), 300)
    frame = spark.createDataFrame([(c, "s" if c % 3 else "") for c in ids], "conv_id long, seq string")
    found = {r["name"]: r["ends"] for r in trie.end_digests(frame).collect()}
    for seq in ("s", ""):
        own = sorted(c for c in ids if ("s" if c % 3 else "") == seq)
        assert found[hashlib.md5(seq.encode()).hexdigest()] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
