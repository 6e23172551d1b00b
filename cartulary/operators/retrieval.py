"""Scoped similarity search and evidence-boosted ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.text import location_label
from cartulary.session import settle

SCOPE_NODE_EVIDENCE = "node_evidence"
SCOPE_DOCUMENT = "document"
SCORE_DIGITS = 9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix; rows of unequal length are an error."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = set(np.asarray(lists.value_lengths()).tolist())
    if len(sizes) > 1:
        raise ValueError("vectors differ in their number of dimensions")
    values = np.asarray(lists.flatten(), dtype=float)
    return values.reshape(len(lists), -1) if sizes else np.zeros((0, 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0.0, 1.0, norms)[:, None]


def _best_of_block(limit: int, floor: float | None, schema: pa.Schema):
    """Score one block of questions against one block of chunks; keep each question's best ``limit``."""

    def score(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        if questions.num_rows == 0 or vectors.num_rows == 0:
            return schema.empty_table()
        left, right = _matrix(questions["embedding"]), _matrix(vectors["embedding"])
        if left.shape[1] != right.shape[1]:
            raise ValueError("vectors differ in their number of dimensions")
        scores = np.round(_unit(left) @ _unit(right).T, SCORE_DIGITS)
        chunk_index = np.asarray(vectors["chunk_index"])
        order = np.lexsort((np.broadcast_to(chunk_index, scores.shape), -scores), axis=1)[:, :limit]
        rows = np.repeat(np.arange(len(left)), order.shape[1])
        picks = order.ravel()
        values = scores[rows, picks]
        if floor is not None:
            keep = values >= floor
            rows, picks, values = rows[keep], picks[keep], values[keep]
        return pa.table(
            {
                "question_id": questions["question_id"].take(pa.array(rows)),
                "document_id": vectors["document_id"].take(pa.array(picks)),
                "chunk_id": vectors["chunk_id"].take(pa.array(picks)),
                "chunk_index": vectors["chunk_index"].take(pa.array(picks)).cast(pa.int64()),
                "score": pa.array(values),
            },
            schema=schema,
        )

    return score


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def scoped_candidates(
    questions: DataFrame,
    vectors: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    limit: int | None = None,
    floor: float | None = None,
) -> DataFrame:
    """Best ``limit`` chunks per question inside the question's own document, by cosine.

    Both sides are cut into blocks, so a document that holds a third of all chunks, or is asked a third of all
    questions, becomes many groups of bounded size. A group emits at most ``limit`` rows per question; pairs
    are never materialised. Chunks go through one shuffle per question block of their document, which is one
    unless the document has more than ``question_block`` questions.
    """
    limit = settings.retrieval_top_k * settings.retrieval_candidate_multiplier if limit is None else limit
    vectors = vectors.select("document_id", "chunk_id", F.col("chunk_index").cast("long"), "embedding")
    questions = questions.select("question_id", "document_id", "embedding")
    id_type = dict(vectors.dtypes)["document_id"]
    question_type = dict(questions.dtypes)["question_id"]
    chunk_type = dict(vectors.dtypes)["chunk_id"]
    schema = pa.schema(
        [
            ("question_id", _ARROW[question_type]),
            ("document_id", _ARROW[id_type]),
            ("chunk_id", _ARROW[chunk_type]),
            ("chunk_index", pa.int64()),
            ("score", pa.float64()),
        ]
    )
    ddl = (
        f"question_id {question_type}, document_id {id_type}, chunk_id {chunk_type}, "
        "chunk_index bigint, score double"
    )
    if limit <= 0:
        return questions.sparkSession.createDataFrame([], ddl)

    # Which blocks exist: two small tables of one row per (document, block).
    vectors = vectors.withColumn("vblock", F.floor(F.col("chunk_index") / F.lit(settings.vector_block)))
    per_document = questions.groupBy("document_id").agg(F.count("*").alias("asked"))
    with_load = questions.join(per_document, "document_id").select(
        "question_id",
        "document_id",
        "embedding",
        F.pmod(
            F.xxhash64("question_id"),
            F.ceil(F.col("asked") / F.lit(settings.question_block)).cast("bigint"),
        ).alias("qblock"),
    )
    vector_blocks = vectors.select("document_id", "vblock").distinct()
    question_blocks = per_document.select(
        "document_id",
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("asked") / F.lit(settings.question_block)) - 1)
        ).alias("qblock"),
    )
    left = with_load.join(vector_blocks, "document_id").select(
        F.col("document_id").alias("ldoc"),
        F.col("vblock").alias("lv"),
        F.col("qblock").alias("lq"),
        "question_id",
        "embedding",
    )
    right = vectors.join(question_blocks, "document_id")
    scored = (
        left.groupBy("ldoc", "lv", "lq")
        .cogroup(right.groupBy("document_id", "vblock", "qblock"))
        .applyInArrow(_best_of_block(limit, floor, schema), ddl)
    )
    return _top(scored, limit, [F.col("score").desc(), F.col("chunk_index").asc()])


def _rounded(score: Column) -> Column:
    """Six digits, half away from zero in floating point as in the SQL; ``F.round`` goes by the decimal notation."""
    return F.signum(score) * F.floor(F.abs(score) * 1e6 + 0.5) / 1e6


def _top(frame: DataFrame, limit: int, order: list, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy("question_id").orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def retrieve(
    questions: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    node_evidence: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    *,
    top_k: int | None = None,
    min_score: float | None = None,
    boost: float | None = None,
    undefined: DataFrame | None = None,
) -> DataFrame:
    """Ranked hits per question.

    ``questions``: question_id, document_id, embedding (and node_id when ``node_evidence`` is given).
    ``node_evidence``: (node_id, chunk_id). The candidate cut and the threshold use the plain score; the boost
    only re-orders what is left. Hits whose chunk row is gone are dropped. ``undefined`` (question_id,
    document_id, chunk_id, chunk_index): pairs whose score is to count as NaN, which ranks before all numbers.
    """
    k = top_k or settings.retrieval_top_k
    floor = settings.retrieval_min_score if min_score is None else min_score
    lift = settings.node_evidence_boost if boost is None else boost
    cut = k * settings.retrieval_candidate_multiplier if k > 0 else 0
    # A few rows per question. Written down, their true size lets the planner broadcast them to the chunk and
    # evidence tables instead of shuffling those.
    best = scoped_candidates(questions, vectors, settings, limit=cut, floor=floor).drop("rank")
    if undefined is not None:
        best = best.unionByName(undefined.withColumn("score", F.lit(float("nan"))))
        best = _top(best, cut, [F.col("score").desc(), F.col("chunk_index").asc()]).drop("rank")
    candidates = settle(best)
    live = candidates.drop("chunk_index", "document_id").join(
        chunks.select(
            "chunk_id",
            "document_id",
            F.col("chunk_index").cast("int").alias("chunk_index"),
            "section_index",
            "section_title",
            "text",
            "page_number",
            "paragraph_index",
        ),
        "chunk_id",
    )
    if node_evidence is None:
        scoped = live.withColumn("__in_scope", F.lit(False))
    else:
        asked = questions.select("question_id", "node_id")
        pairs = candidates.join(asked, "question_id").select("node_id", "chunk_id").distinct()
        marks = (
            node_evidence.select("node_id", "chunk_id")
            .join(pairs, ["node_id", "chunk_id"], "left_semi")
            .distinct()
            .withColumn("__mark", F.lit(True))
        )
        scoped = (
            live.join(asked, "question_id")
            .join(marks, ["node_id", "chunk_id"], "left")
            .withColumn("__in_scope", F.col("__mark").isNotNull())
        )
    ranked = scoped.select(
        "question_id",
        "chunk_id",
        "document_id",
        "chunk_index",
        "section_index",
        "section_title",
        "text",
        "page_number",
        "paragraph_index",
        _rounded(F.col("score") + F.when(F.col("__in_scope"), F.lit(lift)).otherwise(F.lit(0.0))).alias("score"),
        F.when(F.col("__in_scope"), SCOPE_NODE_EVIDENCE).otherwise(SCOPE_DOCUMENT).alias("scope"),
        location_label(F.col("page_number"), F.col("paragraph_index")).alias("location"),
    )
    return _top(ranked, max(k, 0), [F.col("score").desc(), F.col("chunk_index").asc()])


def index_drift(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk no longer exists."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
