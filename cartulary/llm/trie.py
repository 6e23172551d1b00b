"""Prefix tries of conversations from vertical bitmaps, shard by shard.

Every conversation becomes a sequence of turn digests; equal sequences become one row with their number and smallest
id. The distinct sequences are sorted by range, which puts every trie node's sequences side by side, and cut into shards
of ``SHARD`` neighbours. A shard indexes (position, turn) to bitsets over its sequences. A depth-first walk intersects
the parent's bitset with the posting of the lowest turn that is left: the intersection is a child, its population the
child's sequences, a sequence that ends there the node's end list.

Node values are sums over the shard's sequences when it is known which nodes the sequence before opened already:
members, opened children, leaves, code points of members less code points of opened nodes. So only nodes on the two
rims of a shard, which a neighbour also holds, are added up by key; all others are complete where they are found.

End lists of any length are hashed as sorted blocks of ids that stream through one task each.

Defined cases: a null ``conv_id`` is no conversation; null roles and texts are empty; null turns come first; rows of one
turn number follow by their digest, and repeated rows are repeated turns; no conversations give no nodes; other columns
are ignored. The turn digests of one sequence travel as one row of 32 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import settle

#: Ids that differ below this number share the opening of the conversation that it divides.
FAMILY = 100
#: Turns of the opening are fewer than this.
OPENINGS = 6
#: Sequences of a shard, as a power of two.
SHARD_BITS = 10
ID_BLOCK_BITS = 16
_DIGEST = 32
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, key string, parent_key string, partial boolean"
)
_NOTHING = hashlib.sha256(b"").hexdigest()


def opening(conv_id: Column) -> Column:
    """Number of turns that a conversation takes from its family's first."""
    return F.crc32(conv_id.cast("string")) % OPENINGS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): digests of the rebuilt turns, one after the other, and the code points of each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"),
        F.length(text).alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
    numbered = turns.withColumn("at", F.row_number().over(order)).withColumn("h", opening(F.col("conv_id")))
    turn = F.struct("at", "mark", "size")
    lists = settle(
        numbered.groupBy("conv_id", "h").agg(
            F.array_sort(F.collect_list(F.when(F.col("at") > F.col("h"), turn))).alias("own"),
            F.array_sort(F.collect_list(F.when((F.col("at") < OPENINGS) & (F.col("conv_id") % FAMILY == 0), turn))).alias("head"),
        )
    )
    heads = lists.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), "head")
    own = lists.select("conv_id", "h", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    opened = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    joined = own.join(heads, "first", "left").select("conv_id", F.concat(opened, "own").alias("turns"))
    return joined.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["mark"]), "").alias("seq"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )


def end_digests(sequences: DataFrame) -> DataFrame:
    """(name, ends): digest of the ascending ids of each sequence, by the sequence's own digest."""
    blocks = sequences.groupBy(F.md5("seq").alias("name"), F.shiftright("conv_id", ID_BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list("conv_id")).alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for other, ids in zip(batch["name"].to_pylist(), batch["ids"]):
                listed = ",".join(map(str, ids.values.to_pylist())).encode()
                if other == name:
                    digest.update(b"," + listed)
                    continue
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = other, hashlib.sha256(listed)
            yield _pairs(done)
        yield _pairs([(name, digest.hexdigest())] if name is not None else [])

    def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["name", "ends"])

    return blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids").mapInArrow(run, "name string, ends string")


def _common(left: list[str], right: list[str]) -> int:
    n = 0
    for a, b in zip(left, right):
        if a != b:
            break
        n += 1
    return n


def _marks(seq: str) -> list[str]:
    return [seq[at : at + _DIGEST] for at in range(0, len(seq), _DIGEST)]


def shard_nodes(rows: list[tuple[str, list[int], int, int, str]], before: str | None, after: str | None) -> list[tuple]:
    """Nodes of one shard, as rows of ``_NODE``.

    ``rows`` are (sequence, code points, members, smallest id, end digest) in ascending order of sequences; ``before`` and
    ``after`` are the sequences next to the shard.
    """
    marks = [_marks(r[0]) for r in rows]
    if not rows:
        return []
    postings: dict[tuple[int, str], int] = {}
    for bit, own in enumerate(marks):
        for place in enumerate(own):
            postings[place] = postings.get(place, 0) | (1 << bit)
    first_shared = -1 if before is None else _common(_marks(before), marks[0])
    last_shared = -1 if after is None else _common(_marks(after), marks[-1])
    known = [first_shared, *(_common(a, b) for a, b in zip(marks, marks[1:]))]
    goes_on = [known[n + 1] == len(own) if n + 1 < len(rows) else last_shared == len(own) for n, own in enumerate(marks)]
    everything = (1 << len(rows)) - 1
    last_bit = 1 << (len(rows) - 1)
    nodes: list[list] = []  # parent, depth, size, opened, partial, key, [conv, n, children, leaves, of members, of nodes], ends

    def visit(parent: int, depth: int, bits: int) -> int:
        low = (bits & -bits).bit_length() - 1
        partial = bool(bits & 1 and depth <= first_shared or bits & last_bit and depth <= last_shared)
        key = None
        if partial:
            above = nodes[parent][5] if parent >= 0 else ""
            key = hashlib.blake2b((above + (marks[low][depth - 1] if depth else "root")).encode(), digest_size=16).hexdigest()
        size = rows[low][1][depth - 1] if depth else 0
        nodes.append([parent, depth, size, known[low] < depth, partial, key, [None, 0, 0, 0, 0, 0], None])
        return len(nodes) - 1

    stack = [(visit(-1, 0, everything), everything)]
    while stack:
        number, left = stack.pop()
        depth = nodes[number][1]
        low = (left & -left).bit_length() - 1
        if len(marks[low]) == depth:
            _, _, members, least, ends = rows[low]
            nodes[number][6] = [least, members, 0, 0 if goes_on[low] else 1, 0, 0]
            nodes[number][7] = ends
            left ^= 1 << low
        while left:
            low = (left & -left).bit_length() - 1
            child = left & postings[depth, marks[low][depth]]
            left ^= child
            stack.append((visit(number, depth + 1, child), child))
    for parent, _, size, opened, _, _, sums, _ in reversed(nodes):  # children stand behind their parents
        sums[4] += sums[1] * size
        sums[5] += size if opened else 0
        if parent >= 0:
            up = nodes[parent][6]
            up[0] = sums[0] if up[0] is None else min(up[0], sums[0])
            up[1] += sums[1]
            up[2] += opened
            for at in (3, 4, 5):
                up[at] += sums[at]
    out = []
    for parent, depth, _, _, partial, key, (conv, n, children, leaves, of_members, of_nodes), ends in nodes:
        above = nodes[parent] if parent >= 0 else None
        rim = above is not None and above[4]
        out.append(
            (conv, depth, above[6][0] if above and not rim else None, n, children, leaves, of_members - of_nodes, ends, key, above[5] if rim else None, partial)
        )
    return out


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """The contract's rows for ``sequences(conv_id, seq, sizes)``; ``conv_id`` is unique."""
    ends = end_digests(sequences)
    distinct = sequences.groupBy("seq").agg(F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"))
    named = distinct.withColumn("name", F.md5("seq")).join(ends, "name").drop("name")
    ranked = settle(named.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("rank", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("shard", F.shiftright("rank", SHARD_BITS))
    span = F.shiftright("shard", 33 - SHARD_BITS)  # the range partition, whose number is in the upper bits
    rims = ranked.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).withColumn("span", span)
    along, over = Window.partitionBy("span").orderBy("shard"), Window.orderBy("span")  # over: one row a range partition
    spans = rims.groupBy("span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.select("span", F.lag("last").over(over).alias("span_before"), F.lead("first").over(over).alias("span_after"))
    inside = rims.select("shard", "span", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    beside = inside.join(spans, "span").select(F.col("shard").alias("beside"), F.coalesce("before", "span_before").alias("before"), F.coalesce("after", "span_after").alias("after"))
    kinds = [(f.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for f in _NODE.split(", ")]

    def run(own: pa.Table, rim: pa.Table) -> pa.Table:
        own = own.sort_by("seq")
        rows = list(zip(*(own[c].to_pylist() for c in ("seq", "sizes", "members", "least", "ends"))))
        found = shard_nodes(rows, rim["before"][0].as_py(), rim["after"][0].as_py())
        columns = list(zip(*found)) or [()] * len(kinds)
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], names=[n for n, _ in kinds])

    nodes = settle(ranked.drop("rank").groupBy("shard").cogroup(beside.groupBy("beside")).applyInArrow(run, _NODE))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = settle(
        nodes.where("partial").groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends"), F.first("parent_key").alias("parent_key")
        )
    )
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = nodes.where("not partial and parent_key is null").select(*columns, "parent_conv_id")
    top = merged.where("parent_key is null").select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))
    below = nodes.where("not partial and parent_key is not null").select(*columns, "parent_key").unionByName(
        merged.where("parent_key is not null").select(*columns, "parent_key")
    )
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    every = inner.unionByName(top).unionByName(below.join(above, "parent_key").select(*columns, "parent_conv_id"))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations."""
    return prefix_nodes(settle(rebuilt(conversations)))


ORACLE = f"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda s, b: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), ids AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) % {OPENINGS} AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), steps
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns FROM clean GROUP BY conv_id
), whole AS (
  SELECT l.conv_id, list_concat(coalesce(b.turns[1:h], []), l.turns[h + 1:]) AS seq
  FROM lists l JOIN ids USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % {FAMILY}
), prefixes AS (
  SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM whole
), nodes AS (
  SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
), children AS (
  SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[-1].text) END AS saved
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
), above AS (
  SELECT node, unnest(range(0, depth + 1)) AS top, n_children, saved FROM counted
), trees AS (
  SELECT node[1:top] AS node, top AS depth, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN trees t ON t.depth = c.depth AND t.node = c.node
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.node[1:c.depth - 1]
"""
