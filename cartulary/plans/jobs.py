"""End-to-end jobs over stored tables under one root folder.

Each job states what it replaces. Re-indexing a document drops the evidence that points at its chunks, and
rebuilding a tree drops the document's questions, as their rows would point at nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.vectors import model_name
from cartulary.operators import answers as A
from cartulary.operators import enrichment as R
from cartulary.operators.chunks import chunk_sections, chunks_aligned
from cartulary.operators.embedding import vector_records
from cartulary.operators.evidence import TARGET_ANSWER, TARGET_EDGE, TARGET_NODE, link_evidence
from cartulary.operators.outline import build_tree, tree_status
from cartulary.operators.tree import map_json
from cartulary.session import settle
from cartulary.sources.store import Transaction, append_states, read_store


@dataclass(frozen=True)
class Store:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


def index_documents(
    documents: DataFrame, sections: DataFrame, store: Store, settings: Settings = DEFAULTS, *, family: str = "blake2b"
) -> DataFrame:
    """Chunk and embed; returns the new status per document. Repeating it writes the same rows.

    ``documents``: document_id. A document without any chunk fails with a code and a message.
    """
    model = model_name(settings.embedding_dimensions)
    chunks = settle(chunk_sections(sections, settings, embedding_model=model))
    change = Transaction(documents.sparkSession, store.root)
    change.replace(chunks, "chunks", documents)
    change.replace(vector_records(chunks, settings, family=family).drop("text"), "vectors", documents)
    change.remove("evidence", documents)
    change.commit()
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    empty = F.col("chunk_count").isNull()
    return documents.select("document_id").join(counted, "document_id", "left").select(
        "document_id",
        F.when(empty, "failed").otherwise("indexed").alias("status"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.lit(model).alias("embedding_model"),
        F.when(empty, "processing_failed").alias("error_code"),
        F.when(empty, "The document contains no extractable text.").alias("error_message"),
    )


def build_trees(
    titles: DataFrame,
    sections: DataFrame,
    store: Store,
    enriched: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    *,
    family: str = "blake2b",
) -> DataFrame:
    """Outline, optional enrichment, evidence and map model; returns the tree nodes.

    ``tree_status`` holds a row per document: a document that is too wide for a tree is stored as failed.

    Documents whose stored chunks no longer match the sections are indexed again first.
    """
    spark = titles.sparkSession
    documents = titles.select("document_id")
    aligned = chunks_aligned(documents, sections, read_store(spark, store.path("chunks")))
    outdated = settle(aligned.filter(~F.col("aligned")).select("document_id"))
    if not outdated.isEmpty():
        index_documents(
            outdated, sections.join(outdated, "document_id", "left_semi"), store, settings, family=family
        )
    nodes = settle(build_tree(sections, titles, settings))
    if enriched is not None:
        rows = settle(R.accepted_rows(enriched, R.targets(nodes, sections)))
        nodes = settle(R.apply_rows(nodes, rows))
    chunks = read_store(spark, store.path("chunks")).join(documents, "document_id", "left_semi")
    edges, links = link_evidence(nodes, chunks, settings)
    links = settle(links)
    change = Transaction(spark, store.root)
    change.replace(nodes, "nodes", documents)
    change.replace(tree_status(titles, sections, settings), "tree_status", documents)
    change.replace(edges, "edges", documents)
    change.replace(links, "evidence", documents, within=("target_type", (TARGET_NODE, TARGET_EDGE, TARGET_ANSWER)))
    change.replace(map_json(nodes, links), "maps", documents)
    change.commit()
    return nodes


def answer(
    questions: DataFrame, store: Store, drafts: DataFrame | None = None, settings: Settings = DEFAULTS,
    *, family: str = "blake2b", model: str | None = None,
) -> DataFrame:
    """Context, reply, citations and states of every question; returns the replies.

    The log of states says queued, running, and answered, insufficient_evidence or failed; a question on a node that
    does not exist fails, and so do all questions of a job that raises.
    """
    asked = settle(questions)
    _log(asked, "queued", store)
    try:
        _log(asked, "running", store)
        return _answered(asked, store, drafts, settings, family, model)
    except Exception as error:
        _log(asked, "failed", store, f"{type(error).__name__}: {error}"[:500])
        raise


def _log(questions: DataFrame, status: str, store: Store, reason: str | None = None) -> None:
    states = questions.select("question_id", "node_id", "question", "intent", F.lit(status).alias("status"), F.lit(reason).cast("string").alias("refusal_reason"))
    append_states(states.withColumn("at", F.current_timestamp()), store.path("question_states"))


def _answered(questions: DataFrame, store: Store, drafts: DataFrame | None, settings: Settings, family: str, model: str | None) -> DataFrame:
    spark: SparkSession = questions.sparkSession
    nodes, links = read_store(spark, store.path("nodes")), read_store(spark, store.path("evidence"))
    chunks, vectors = read_store(spark, store.path("chunks")), read_store(spark, store.path("vectors"))
    if drafts is not None:  # a draft that is no answer fails its question
        rejected = settle(A.rejected_drafts(drafts))
        failed = questions.join(rejected, "question_id").select("question_id", "node_id", "question", "intent", F.lit("failed").alias("status"), F.col("problem").alias("refusal_reason"))
        append_states(failed.withColumn("at", F.current_timestamp()), store.path("question_states"))
        questions = questions.join(rejected, "question_id", "left_anti")
        drafts = drafts.join(rejected, "question_id", "left_anti")
    contexts = settle(A.node_contexts(questions, nodes, links, chunks, vectors, settings, family=family))
    replies = settle(A.answer_questions(contexts, drafts, settings))
    states, answer_links = A.persist_answers(replies, model)
    unknown = questions.join(nodes.select("node_id"), "node_id", "left_anti").select(
        "question_id", "node_id", "question", "intent", F.lit("failed").alias("status"), F.lit("The node does not exist.").alias("refusal_reason")
    )
    states = states.unionByName(unknown, allowMissingColumns=True)
    append_states(states.withColumn("at", F.current_timestamp()), store.path("question_states"))
    # What an earlier run of the same questions cited goes; links are keyed by their target.
    asked = replies.select("document_id", F.col("question_id").alias("target_id"))
    change = Transaction(spark, store.root)
    change.replace_targets(answer_links, "evidence", asked)
    change.commit()
    return replies
