"""Byte-limited shards by extendible hashing.

The directory is indexed by the leading bits of a document's hash. A bucket over the limit splits on its next bit, any
other stays, so a shard is the shortest prefix whose documents fit. Splitting needs only byte totals by prefix, which
are summed over all documents a few bits at a time; cells that still exceed the limit go on.

The hash has 60 bits: 32 of the id and 28 of the text, so rows that repeat an id can still be separated. Rows that agree
in both cannot; where such a cell exceeds the limit it is continued on numbered overflow pages, each a shard of its own.

Defined cases: a null id or text hashes like an empty string and counts no bytes; empty texts cost nothing and go to
their prefix's shard; a single document above the limit is alone in its shard, which is the only way over the limit; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import settle

HASH_BITS = 60
SHARD_BYTES = 1 << 20


def _bits(column: str, digits: int) -> F.Column:
    value = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(value, 1, digits), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, hash) of every row; the hash reads from the highest of its 60 bits."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return own.select("doc_id", size, (_bits("doc_id", 8) * F.lit(1 << 28) + _bits("text", 7)).alias("hash"))


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(depth, prefix, shard_bytes): the leaves. A leaf at full depth may exceed the limit.

    Each round reads the sizes of the open cells alone. Its depth is the one that an even hash would need, and a few
    bits more, so there are few rounds and few cells a shard.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return rows.sparkSession.createDataFrame([], "depth int, prefix long, shard_bytes long")
    above, depth, leaves = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 4), None
    open_cells = rows.select("hash", "n_bytes")
    while True:
        cells = settle(open_cells.groupBy(F.shiftright("hash", HASH_BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")))
        levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {depth} - depth)")
        sums = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"))
        fits = sums if depth == HASH_BITS else sums.where(F.col("shard_bytes") <= limit)
        if depth == HASH_BITS:
            fits = fits.where((F.col("shard_bytes") <= limit) | (F.col("depth") == depth))
        # a leaf fits and its parent does not; a root that fits at once has no parent
        parent = sums.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = fits.withColumn("parent", F.shiftright("prefix", 1))
        roots = fits.where(F.col("depth") == above).drop("parent") if above == 0 else None
        found = fits.join(parent, ["depth", "parent"], "left_semi").select("depth", "prefix", "shard_bytes")
        if roots is not None:
            found = found.unionByName(roots.select("depth", "prefix", "shard_bytes"))
        found = settle(found)
        leaves = found if leaves is None else leaves.unionByName(found)
        wide = cells.where(F.col("n_bytes") > limit).select("cell")
        if depth == HASH_BITS or wide.isEmpty():
            return leaves
        open_cells = open_cells.withColumn("cell", F.shiftright("hash", HASH_BITS - depth)).join(wide, "cell", "left_semi").drop("cell")
        above, depth = depth, min(HASH_BITS, depth + 8)


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page, shard_bytes) of every row; depth, prefix and page name the shard."""
    rows = settle(sized(docs).withColumn("part", F.spark_partition_id()))
    leaves = settle(directory(rows, limit))
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most 61 of them
    prefixes = F.array(*(F.struct(F.lit(d).cast("int").alias("depth"), F.shiftright("hash", HASH_BITS - d).alias("prefix")) for d in sorted(depths)))
    if not depths:
        return rows.selectExpr("doc_id", "n_bytes", "0 depth", "0L prefix", "0L page", "0L shard_bytes")
    # each row meets its leaf on the cell of the deepest directory; leaves that are shallower cover several cells
    deepest = min(max(depths), 62)
    placed = _join_leaves(rows, leaves, deepest) if deepest <= 20 else (
        rows.withColumn("at", F.explode(prefixes)).select("*", "at.depth", "at.prefix").drop("at").join(leaves, ["depth", "prefix"])
    )
    fitting = placed.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    return fitting.unionByName(_pages(placed.where(F.col("shard_bytes") > limit), limit), allowMissingColumns=False).select(
        "doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", "page", "shard_bytes"
    )


def _join_leaves(rows: DataFrame, leaves: DataFrame, deepest: int) -> DataFrame:
    cells = leaves.withColumn("cell", F.explode(F.expr(
        f"sequence(shiftleft(prefix, {deepest} - depth), shiftleft(prefix + 1, {deepest} - depth) - 1)"
    )))
    return rows.withColumn("cell", F.shiftright("hash", HASH_BITS - deepest)).join(cells, "cell").drop("cell")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of cells that no bit can split: rows are numbered by the writing task and then within it."""
    within = Window.partitionBy("hash", "part").orderBy("doc_id", "n_bytes")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    counts = rows.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most"))
    before = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("hash", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.max("most").over(Window.partitionBy("hash")).alias("most"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("most"), F.lit(1))))
    paged = numbered.join(starts, ["hash", "part"]).withColumn("page", F.floor((F.col("base") + F.col("nth")) / each).cast("long"))
    sizes = paged.groupBy("hash", "page").agg(F.sum("n_bytes").alias("page_bytes"))
    return paged.join(sizes, ["hash", "page"]).withColumn("shard_bytes", F.col("page_bytes")).select(*rows.columns, "page")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, COALESCE(strlen(text), 0) AS n_bytes,
    CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) * {1 << 28}
    + CAST('0x' || substr(md5(COALESCE(text, '')), 1, 7) AS BIGINT) AS hash
  FROM documents
), sums AS (
  SELECT d.depth, hash >> ({HASH_BITS} - d.depth) AS prefix, SUM(n_bytes) AS shard_bytes
  FROM sized, (SELECT CAST(range AS INTEGER) AS depth FROM range({HASH_BITS + 1})) d GROUP BY 1, 2
), leaf AS (
  SELECT s.doc_id, s.hash, s.n_bytes, MIN(t.depth) AS depth FROM sized s
  JOIN sums t ON t.shard_bytes <= {SHARD_BYTES} AND t.prefix = s.hash >> ({HASH_BITS} - t.depth) GROUP BY ALL
)
SELECT l.doc_id, CAST(l.n_bytes AS BIGINT) AS n_bytes, l.depth, t.prefix, CAST(0 AS BIGINT) AS page,
  CAST(t.shard_bytes AS BIGINT) AS shard_bytes
FROM leaf l JOIN sums t ON t.depth = l.depth AND t.prefix = l.hash >> ({HASH_BITS} - l.depth)
"""
