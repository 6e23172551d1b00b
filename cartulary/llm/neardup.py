"""MinHash near-duplicate groups; odd sketches choose what is compared, whole texts decide.

Texts with equal shingle sets form a class first. Classes that share a band meet at the bucket's least class, and
the pairs are confirmed on the whole shingle sets. Buckets that still hold several groups are searched in blocks with
odd sketches: XOR population counts choose each member's plausible partners in other groups, whole sets confirm them in
the same task, and only links that join groups leave it. So links between texts that the first pivot does not resemble
are found as well, and neither copies nor members of a group become pairs.

Defined cases: null and empty texts have an empty set and no links; a null ``doc_id`` is never linked and keeps a
null component; rows that repeat a ``doc_id`` each get their class's component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.graph import components, merged
from cartulary.llm.neardup_sketch import Signer, WordHashes, shingles, sketch_similarity, words_of
from cartulary.session import settle

_SIGNED = "doc_id long, n_shingles long, class binary, bands array<long>, sketch binary, packed binary"


@dataclass(frozen=True)
class NearDupSettings:
    """``share`` percent of the union must be common. A link at 0.85 misses all 24 bands of 5 with 8e-7; its odd sketch
    lies more than ``slack`` below with 2e-7."""

    width: int = 3
    share: int = 85
    bands: int = 24
    rows: int = 5
    sketch_bits: int = 1024
    slack: float = 0.20
    block: int = 2048


def sign(docs: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Set size, class key, bands, odd sketch and packed words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = WordHashes(), Signer(settings.bands, settings.rows, settings.sketch_bits)
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part, rows = batch.slice(at, 2000), []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    words = words_of(text)
                    found = shingles(words, settings.width, hashes)
                    key = xxhash.xxh3_128_digest(found.tobytes())
                    if not len(found):
                        rows.append((doc, 0, key, [], b"", b""))
                        continue
                    samples = signer.samples(found)
                    rows.append(
                        (doc, len(found), key, signer.keys(samples), signer.sketch(samples), packer.compress(b" ".join(words)))
                    )
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        names = ("doc_id", "n_shingles", "class", "bands", "sketch", "packed")
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, _SIGNED
    )


def _confirm(pairs: DataFrame, texts: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Pairs (a, b) of nodes with ``linked``: decided on the whole shingle sets of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
        last: tuple = (None, None)
        for batch in batches:
            linked = []
            for left, right in zip(batch["left"], batch["right"]):
                left = left.as_py()
                if left != last[0]:
                    last = (left, shingles(unpack.decompress(left).split(b" "), settings.width, hashes))
                other = shingles(unpack.decompress(right.as_py()).split(b" "), settings.width, hashes)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                linked.append(100 * common >= settings.share * (len(last[1]) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    with_right = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("right")), "b")
    both = with_right.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("left")), "a")
    return settle(both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean"))


def plausible(x: int, others: np.ndarray, sizes: np.ndarray, marks: np.ndarray, bands: np.ndarray, settings: NearDupSettings, key: int) -> np.ndarray:
    """Which of ``others`` may be linked with row ``x`` and share ``key`` as their first band, likely ones first.

    Sets whose sizes forbid a link, and sketches that lie more than ``slack`` below the threshold, are no partners.
    """
    least, most = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
    others = others[100 * least >= settings.share * most]
    differing = np.bitwise_count(marks[others] ^ marks[x]).sum(axis=1)
    close = sketch_similarity(differing, settings.bands * settings.rows, settings.sketch_bits)
    near = close >= settings.share / 100.0 - settings.slack
    others, close = others[near], close[near]
    if len(others):
        first_shared = (bands[others] == bands[x]).argmax(axis=1)
        own = bands[x][first_shared] == key
        others, close = others[own], close[own]
    return others[np.argsort(-close, kind="stable")]


class _Sets:
    """Shingle sets of packed texts; forgets all when they hold more than ``limit`` hashes."""

    def __init__(self, packed: pa.Array, width: int, limit: int = 8_000_000) -> None:
        self.packed, self.width, self.limit, self.held = packed, width, limit, 0
        self.known: dict[int, np.ndarray] = {}
        self.hashes, self.unpack = WordHashes(), zstandard.ZstdDecompressor()

    def of(self, row: int) -> np.ndarray:
        if row not in self.known:
            found = shingles(self.unpack.decompress(self.packed[row].as_py()).split(b" "), self.width, self.hashes)
            if self.held + len(found) > self.limit:
                self.known.clear()
                self.held = 0
            self.known[row] = found
            self.held += len(found)
        return self.known[row]


def _links(buckets: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Links (a, b) between rows of open buckets, as forests: no more than members of a pair of blocks.

    Buckets are cut into blocks of about ``block`` members; a task holds two blocks with their whole texts, looks for
    partners among rows of other components alone, and joins components as it confirms links on the whole sets. A link
    inside a component that is already joined says nothing new and is not looked for. ``buckets`` rows carry key, node,
    component, n_shingles, sketch, bands, packed and the number of blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        own, met = table["home"].to_numpy(), table["other"].to_numpy()
        nodes, sizes, key = table["node"].to_numpy(), table["n_shingles"].to_numpy(), table["key"][0].as_py()
        alone = bool((own == met).all())
        left = np.arange(len(nodes)) if alone else np.flatnonzero(own < met)
        right = left if alone else np.flatnonzero(own > met)
        marks = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(nodes), -1)
        bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(nodes), -1)
        sets = _Sets(table["packed"].combine_chunks(), settings.width)
        groups = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        found: list[tuple[int, int]] = []
        for x in left.tolist():
            for y in plausible(x, right[groups[right] != groups[x]], sizes, marks, bands, settings, key).tolist():
                if groups[x] == groups[y]:
                    continue
                common = len(np.intersect1d(sets.of(x), sets.of(y), assume_unique=True))
                if 100 * common >= settings.share * (sizes[x] + sizes[y] - common):
                    found.append((int(nodes[x]), int(nodes[y])))
                    groups[groups == groups[y]] = groups[x]
        columns = list(zip(*found)) or [()] * 2
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    home = F.pmod(F.xxhash64("node"), F.col("blocks"))
    grid = buckets.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    grid = grid.withColumn("i", F.least("home", "other")).withColumn("j", F.greatest("home", "other"))
    return grid.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, settings: NearDupSettings = NearDupSettings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    signed = settle(sign(docs, settings))
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = settle(linkable.groupBy("class").agg(F.min("doc_id").alias("node")))
    rows = linkable.join(classes, "class")
    lone = rows.where("doc_id = node").dropDuplicates(["class"])
    keys = lone.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).where("members > 1")
    buckets = settle(keys.join(shared, "key").select("key", "node", "pivot", "members"))
    texts = settle(
        rows.where("doc_id = node").join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["class"])
        .select("node", "n_shingles", "sketch", "bands", "packed")
    )
    tried = _confirm(
        buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), texts, settings
    )
    groups = components(tried.where("linked").select("a", "b"))
    placed = buckets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
    ).where(F.col("low") < F.col("high"))
    blocks = F.ceil(F.col("size") / settings.block).cast("long").alias("blocks")
    open_rows = placed.join(several.select("key", blocks), "key").join(texts, "node")
    links = settle(_links(open_rows.select("key", "node", "component", "n_shingles", "sketch", "bands", "packed", "blocks"), settings))
    groups = merged(groups, links)
    named = classes.join(groups, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("class")).alias("class"))
    out = out.join(named, "class", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, settings: NearDupSettings) -> DataFrame:
    """The rows of ``docs`` that stay: one row per group, all its columns unchanged.

    It is the one with the group's smallest ``doc_id``. Rows that repeat a ``doc_id`` with another text, or have none,
    are documents of their own; of rows that repeat both, one stays. Texts without words are in no group and stay.
    """
    key = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.select(key.alias("key"), F.col("doc_id").alias("own_id"), "text")
    groups = near_duplicates(own.select(F.col("key").alias("doc_id"), "text"), settings).select(F.col("doc_id").alias("key"), "component_id")
    named = groups.distinct().join(own.select("key", "own_id").distinct(), "key")
    first = F.min(F.struct(F.col("own_id").isNull().alias("late"), "own_id", "key"))
    chosen = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(_KEY))
    return docs.withColumn(_KEY, key).join(chosen, _KEY, "left_semi").dropDuplicates([_KEY]).select(*docs.columns)


_KEY = "__neardup_key"
