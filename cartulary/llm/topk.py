"""Exact top-k by no-random-access aggregation over sorted lists, in blocks.

Each dimension of a block of vectors is a list sorted by its component. A query reads the lists from the end its own
component favours, all to the same depth. What it has read bounds every vector: unread components are at least the
list's last value (lower bound) and at most the value at the depth (upper bound). With components clipped that way, the
bounds of all queries and vectors of a block pair are two matrix products. A vector whose upper bound stays under the
k-th lower bound is out; when at most a few times k are left, or the lists are read whole, final scores are resolved
from what the lists hold. Blocks' answers are merged by rank.

Vectors and queries meet in a grid of block pairs, each of bounded size, so no block grows with the input.

Defined cases: vectors that are null, hold a null, NaN or infinite component, or have no component take no part, as
query or candidate; so do null ids; vectors only meet vectors of the same dimension; rows that repeat an id are ranked
each, and none of them meets a query of the same id; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import settle

SCALE = 64
K = 20
QUERY_STEP = 20
VECTOR_BLOCK = 2048
QUERY_BLOCK = 1024
#: Shares of the lists that are read one after the other, until the bounds decide.
DEPTHS = (0.25, 0.5, 0.75, 0.9, 1.0)
_EXACT = 2**53


def prepared(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, parts): integer components of the vectors that take part."""
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = own.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    parts = F.transform("embedding", lambda x: F.floor(x * scale).cast("long"))
    return valid.select("vec_id", F.size("embedding").alias("dims"), parts.alias("parts"))


def bounded_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores) of the k best of a block for each query; ties to the smaller id."""
    if not len(vectors) or not len(queries):
        return
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    if largest >= _EXACT:  # beyond exact doubles: whole lists, integer arithmetic
        for query, own in zip(queries.astype(object), query_ids):
            yield own, *_best(vectors.astype(object) @ query, ids, own, k)
        return
    real, asked = vectors.astype(np.float64), queries.astype(np.float64)
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    lists = np.sort(real, axis=0)
    low, high = lists[0], lists[-1]
    waiting = np.arange(len(asked))
    for share in DEPTHS:
        if not len(waiting):
            break
        depth = min(max(4 * k, int(len(real) * share)), len(real))
        whole = depth == len(real)
        top, bottom = lists[len(real) - depth], lists[depth - 1]  # values at the depth, read from either end
        if whole:
            upper = lower = asked[waiting] @ real.T
        else:
            # a favoured component that is read is itself; unread, it lies between the list's end and the depth
            upper = up[waiting] @ np.maximum(real, top).T + down[waiting] @ np.minimum(real, bottom).T
            lower = up[waiting] @ np.where(real >= top, real, low).T + down[waiting] @ np.where(real <= bottom, real, high).T
        rest = []
        for row, number in enumerate(waiting):
            own = query_ids[number]
            if whole:
                yield own, *_best(upper[row], ids, own, k)
                continue
            bounds = np.where(ids == own, -np.inf, lower[row])
            kth = np.partition(bounds, max(0, len(bounds) - k))[max(0, len(bounds) - k)]
            alive = np.flatnonzero((upper[row] >= kth) & (ids != own))
            if len(alive) <= 8 * k:
                yield own, *_best(real[alive] @ asked[number], ids[alive], own, k)
            else:
                rest.append(number)
        waiting = np.array(rest, int)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    other = ids != own
    scores, ids = scores[other], ids[other]
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def exact_top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``step``, its k best others."""
    rows = settle(prepared(vectors))
    asked = rows.where(F.col("vec_id") % step == 0)
    n, m = rows.count(), asked.count()
    blocks, shares = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    # dealt by position of a hash over the whole row: repeated vectors and ids spread over the blocks
    mixed = F.xxhash64("vec_id", "parts")
    left = rows.select("vec_id", "dims", "parts", F.pmod(mixed, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(False).alias("asks"))
    right = asked.select("vec_id", "dims", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(mixed, F.lit(shares)).cast("int").alias("share"), F.lit(True).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False)
        ids = table["vec_id"].to_numpy()
        parts = table["parts"].combine_chunks()
        grid = (parts.flatten() if not isinstance(parts, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in parts.chunks])).to_numpy().reshape(len(ids), -1)
        out: list[list[np.ndarray]] = [[], [], []]
        for own, found, scores in bounded_top(grid[asks], ids[asks], grid[~asks], ids[~asks], k):
            out[0].append(np.full(len(found), own, np.int64))
            out[1].append(found.astype(np.int64))
            out[2].append(np.array(scores, np.int64))
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in out]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    near = left.unionByName(right).groupBy("dims", "block", "share").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH flat AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS part, generate_subscripts(embedding, 1) AS dim
  FROM embeddings WHERE vec_id IS NOT NULL
), sound AS (
  SELECT vec_id FROM flat GROUP BY vec_id HAVING COUNT(*) = COUNT(part) AND bool_and(isfinite(part))
), whole AS (
  SELECT vec_id, dim, CAST(floor(part * {SCALE}) AS BIGINT) AS part FROM flat JOIN sound USING (vec_id)
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(SUM(q.part * v.part) AS BIGINT) AS score
  FROM whole q JOIN whole v ON q.dim = v.dim AND q.vec_id <> v.vec_id
  WHERE q.vec_id % {QUERY_STEP} = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
