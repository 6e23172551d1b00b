"""Questions to contexts, answers, citations and views.

``questions``: question_id, node_id, question, intent. ``nodes`` is the stored tree, ``links`` its evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.config import DEFAULTS, Settings
from cartulary.functions import answers as A
from cartulary.functions.ids import ZERO_UUID, canonical_uuid
from cartulary.functions.text import let, quote_excerpt, strip, trim_to
from cartulary.operators import tree as T
from cartulary.operators.embedding import embed
from cartulary.operators.evidence import TARGET_ANSWER, TARGET_NODE, citations, make_links
from cartulary.operators.retrieval import retrieve
from cartulary.session import settle

ANSWERED = "answered"
INSUFFICIENT = "insufficient_evidence"
MODE_MODEL = "llm"
MODE_EXTRACTIVE = "extractive_fallback"
QUIZ_ITEMS = 4
QUIZ_CONFIDENCE = 0.3
EXTRACTIVE_CONFIDENCE = 0.5
ANSWER_CHARACTERS = 6000
QUIZ_ANSWER_CHARACTERS = 1500
QUIZ_QUESTION_CHARACTERS = 400

_STRINGS = "array<string>"
_CHILDREN = "array<struct<title:string,summary:string>>"
_EVIDENCE = (
    "array<struct<label:string,chunk_id:string,text:string,location:string,section_title:string,score:double>>"
)
_QUIZ = "array<struct<question:string,answer:string,chunk_ids:array<string>>>"
DRAFT_SCHEMA = (
    "question_id string, answer string, cited_evidence_ids array<string>, confidence double, "
    "insufficient_evidence boolean, quiz_items array<struct<question:string,answer:string,"
    "cited_evidence_ids:array<string>>>"
)


def _none(ddl: str) -> Column:
    return F.array().cast(ddl)


def accept_questions(submitted: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Normalise intents and fill default questions; ``reject_code`` is 422 where the text has a bad length."""
    intent = A.normalize_intent(F.col("intent"))
    given = strip(F.coalesce("question", F.lit("")))
    text = F.when(given != "", given).otherwise(A.default_question(intent))
    bad = (F.length(text) < 2) | (F.length(F.coalesce("question", F.lit(""))) > settings.max_question_characters)
    return submitted.withColumn("reject_code", F.when(bad, F.lit(422))).withColumn("question", text).withColumn(
        "intent", intent
    )


def node_contexts(
    questions: DataFrame,
    nodes: DataFrame,
    links: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    family: str = "blake2b",
    documents: DataFrame | None = None,
    undefined: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One bounded context per question: node, surroundings and retrieved evidence within the budget.

    A question whose node does not exist disappears here, as it has no document to ask. ``undefined`` gets the
    questions (question_id, document_id, query, embedding) and gives the pairs that ``retrieve`` is to count as NaN.
    """
    asked_nodes = questions.select("node_id").distinct()
    # Everything about the surroundings is limited to the documents that are asked.
    involved = nodes.join(asked_nodes, "node_id", "left_semi").select("document_id").distinct()
    local = settle(nodes.join(involved, "document_id", "left_semi"))
    # Only those that are shown or asked with are listed, however many a node has.
    below = T.children(local, max(settings.context_children, A.NAMED_CHILDREN)).select(
        "node_id", F.transform("children", lambda c: F.struct(c["title"].alias("title"), c["summary"].alias("summary"))).alias("children")
    )
    counted = local.groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).cast("int").alias("__below"))
    facts = settle(
        questions.join(local.select("node_id", "document_id", "title", "summary", "keywords"), "node_id")
        .join(below, "node_id", "left")
        .join(counted, "node_id", "left")
        .withColumn("children", F.coalesce("children", _none(_CHILDREN)))
        .withColumn(
            "query",
            A.retrieval_query(
                F.col("title"),
                F.col("summary"),
                F.col("intent"),
                F.col("question"),
                F.transform("children", lambda c: c["title"]),
                settings.query_max_characters,
            ),
        )
    )
    vectored = settle(embed(facts.select("question_id", "node_id", "document_id", "query"), "query", settings, family=family))
    evidence = (
        links.filter(F.col("target_type") == TARGET_NODE)
        .select(F.col("target_id").alias("node_id"), "chunk_id")
        .join(asked_nodes, "node_id", "left_semi")
    )
    void = None if undefined is None else undefined(vectored)
    hits = retrieve(vectored.drop("query"), vectors, chunks, evidence, settings, undefined=void)
    item = F.struct(
        "rank",
        F.struct(
            F.concat(F.lit("c"), F.col("rank").cast("string")).alias("label"),
            "chunk_id",
            "text",
            "location",
            "section_title",
            "score",
        ).alias("item"),
    )
    found = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("__hits"))
    root = T.roots(local).select("document_id", F.col("title").alias("document_title"))
    near = T.siblings(local, settings.context_siblings).select(
        "node_id", F.transform("siblings", lambda s: s["title"]).alias("siblings")
    ).join(asked_nodes, "node_id", "left_semi")
    above = T.ancestors(local, settings).select("node_id", F.col("ancestors").alias("breadcrumb")).join(
        asked_nodes, "node_id", "left_semi"
    )
    joined = (
        facts.join(found, "question_id", "left")
        .join(root, "document_id", "left")
        .join(near, "node_id", "left")
        .join(above, "node_id", "left")
    )
    if documents is not None:
        joined = joined.join(documents.select("document_id", "original_filename"), "document_id", "left").withColumn(
            "document_title", F.coalesce("document_title", "original_filename")
        )
    titled = joined.withColumn("document_title", F.coalesce("document_title", F.lit("")))
    fixed = F.length("document_title") + F.length("title") + F.length("summary")
    chosen = titled.withColumn(
        "__evidence", A.select_evidence(F.coalesce(F.transform("__hits", lambda h: h["item"]), _none(_EVIDENCE)), fixed, settings)
    )
    dropped_children = F.greatest(F.coalesce("__below", F.lit(0)) - settings.context_children, F.lit(0))
    return chosen.select(
        "question_id",
        "document_id",
        "node_id",
        "intent",
        "question",
        "query",
        F.struct(
            F.col("document_title").alias("document_title"),
            F.coalesce("breadcrumb", _none(_STRINGS)).alias("breadcrumb"),
            F.col("title").alias("node_title"),
            F.col("summary").alias("node_summary"),
            F.col("keywords").alias("keywords"),
            F.slice("children", 1, settings.context_children).alias("children"),
            F.slice(F.coalesce("siblings", _none(_STRINGS)), 1, settings.context_siblings).alias("siblings"),
            F.col("__evidence.kept").alias("evidence"),
            ((F.col("__evidence.dropped") > 0) | (dropped_children > 0)).alias("truncated"),
            F.col("__evidence.dropped").alias("dropped_evidence"),
            dropped_children.alias("dropped_children"),
        ).alias("context"),
    )


def _result(
    answer: Column, chunk_ids: Column, confidence: Column, refusal: Column, quiz: Column | None = None
) -> Column:
    return F.struct(
        answer.cast("string").alias("answer"),
        chunk_ids.cast(_STRINGS).alias("chunk_ids"),
        confidence.cast("double").alias("confidence"),
        refusal.isNotNull().alias("refused"),
        refusal.cast("string").alias("refusal_reason"),
        (quiz if quiz is not None else _none(_QUIZ)).cast(_QUIZ).alias("quiz_items"),
    )


def extractive_result(evidence: Column, settings: Settings = DEFAULTS) -> Column:
    """Verbatim quotes with bounded confidence, or a refusal."""
    def shape(fold: Column) -> Column:
        quoted = F.size(fold["quotes"]) > 0
        return _result(
            F.when(quoted, F.array_join(fold["quotes"], "\n\n")),
            fold["chunk_ids"],
            F.when(quoted, F.least(F.lit(EXTRACTIVE_CONFIDENCE), F.get(evidence, F.lit(0))["score"])),
            F.when(F.size(evidence) == 0, A.REFUSED_NO_MATCH).when(~quoted, A.REFUSED_NO_TEXT),
        )

    return let(A.extractive_quotes(evidence, settings.answer_max_characters), shape)


def outline_quiz(context: Column) -> Column:
    """Up to four questions from the children, else one about the node; all cite the first evidence."""
    first = F.get(context["evidence"], F.lit(0))["chunk_id"]
    make = lambda q, a: F.struct(q.alias("question"), a.alias("answer"), F.array(first).alias("chunk_ids"))
    from_children = F.transform(
        F.slice(context["children"], 1, QUIZ_ITEMS),
        lambda c: make(F.concat(F.lit("请说明「"), c["title"], F.lit("」的含义及其作用。")), c["summary"]),
    )
    about_node = F.array(
        make(
            F.concat(F.lit("请用自己的话解释「"), context["node_title"], F.lit("」。")),
            F.when(context["node_summary"] != "", context["node_summary"]).otherwise(context["node_title"]),
        )
    )
    items = F.when(F.size(context["children"]) > 0, from_children).otherwise(about_node)
    answer = F.concat(F.lit("未配置模型，以下测试题依据该节点的子节点生成，共 "), F.size(items).cast("string"), F.lit(" 题。"))
    return _result(answer, F.array(first), F.lit(QUIZ_CONFIDENCE), F.lit(None), items)


# Limits of a draft.
MAX_LABELS, MAX_QUIZ_ITEMS, MAX_QUIZ_LABELS = 8, 8, 6


def draft_problem(draft: Column) -> Column:
    """Why a model's draft is no answer at all, null for a usable one; over-long texts are trimmed and no problem."""
    items = F.coalesce(draft["quiz_items"], _none("array<struct<question:string,answer:string,cited_evidence_ids:array<string>>>"))
    missing = lambda text: F.coalesce(F.length(text), F.lit(0)) == 0
    outside = ~F.coalesce(draft["confidence"].between(0.0, 1.0), F.lit(False))
    listed = lambda labels: F.coalesce(F.size(F.coalesce(labels, _none(_STRINGS))), F.lit(0))
    return (
        F.when(missing(draft["answer"]), "The draft has no answer.")
        .when(outside, "The draft's confidence is not between 0 and 1.")
        .when(listed(draft["cited_evidence_ids"]) > MAX_LABELS, "The draft cites too many blocks.")
        .when(F.size(items) > MAX_QUIZ_ITEMS, "The draft has too many quiz items.")
        .when(
            F.exists(items, lambda q: missing(q["question"]) | missing(q["answer"]) | (listed(q["cited_evidence_ids"]) > MAX_QUIZ_LABELS)),
            "A quiz item is incomplete or cites too many blocks.",
        )
    )


def rejected_drafts(drafts: DataFrame) -> DataFrame:
    """``(question_id, problem)`` of the drafts that are no answers."""
    draft = F.struct(*[c for c in drafts.columns if c != "question_id"])
    return drafts.select("question_id", draft_problem(draft).alias("problem")).filter(F.col("problem").isNotNull())


def validated_draft(draft: Column, context: Column, intent: Column) -> Column:
    """Keep only what cites evidence of the context; refuse otherwise.

    Over-long texts are trimmed. Quiz items survive for the quiz intent only, and only with a citation.
    """
    cited = A.resolve_labels(draft["cited_evidence_ids"], context["evidence"])
    items = F.filter(
        F.transform(
            F.coalesce(draft["quiz_items"], _none("array<struct<question:string,answer:string,cited_evidence_ids:array<string>>>")),
            lambda q: F.struct(
                strip(trim_to(q["question"], QUIZ_QUESTION_CHARACTERS)).alias("question"),
                strip(trim_to(q["answer"], QUIZ_ANSWER_CHARACTERS)).alias("answer"),
                A.resolve_labels(q["cited_evidence_ids"], context["evidence"]).alias("chunk_ids"),
            ),
        ),
        lambda q: (F.size(q["chunk_ids"]) > 0) & (intent == "quiz"),
    )
    refusal = F.when(F.coalesce(draft["insufficient_evidence"], F.lit(False)), A.REFUSED_INSUFFICIENT).when(
        (F.size(cited) == 0) & (F.size(items) == 0), A.REFUSED_UNTRACED
    )
    return _result(
        F.when(refusal.isNull(), strip(trim_to(draft["answer"], ANSWER_CHARACTERS))),
        F.when(refusal.isNull(), cited).otherwise(_none(_STRINGS)),
        draft["confidence"],
        refusal,
        F.when(refusal.isNull(), items).otherwise(_none(_QUIZ)),
    )


def answer_questions(contexts: DataFrame, drafts: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One reply per question with citations, quiz items, confidence or a refusal.

    Without evidence the reply is a refusal. With a draft it is the validated draft; otherwise quotes, or an
    outline quiz for the quiz intent.
    """
    context = F.col("context")
    staged = contexts
    if drafts is None:
        has_draft = F.lit(False)
        drafted = _result(F.lit(None), _none(_STRINGS), F.lit(None), F.lit(None))
    else:
        staged = contexts.join(
            drafts.select("question_id", F.struct(*[c for c in drafts.columns if c != "question_id"]).alias("draft")),
            "question_id",
            "left",
        )
        has_draft = F.col("draft").isNotNull()
        drafted = validated_draft(F.col("draft"), context, F.col("intent"))
    none_found = F.size(context["evidence"]) == 0
    result = (
        F.when(none_found, _result(F.lit(None), _none(_STRINGS), F.lit(None), F.lit(A.REFUSED_NO_MATCH)))
        .when(has_draft, drafted)
        .when(F.col("intent") == "quiz", outline_quiz(context))
        .otherwise(extractive_result(context["evidence"], settings))
    )
    mode = F.when(~none_found & has_draft, MODE_MODEL).otherwise(MODE_EXTRACTIVE)
    decided = staged.select("question_id", "document_id", "node_id", "intent", "question", "context", mode.alias("mode"), result.alias("r"))

    def cite(ids: Column) -> Column:
        matched = F.transform(
            ids, lambda i: F.get(F.filter(context["evidence"], lambda e: e["chunk_id"] == i), F.lit(0))
        )
        return F.transform(
            F.filter(matched, lambda e: e.isNotNull()),
            lambda e: F.struct(
                e["chunk_id"].alias("chunk_id"),
                quote_excerpt(e["text"]).alias("quote"),
                e["section_title"].alias("section_title"),
                e["location"].alias("location"),
                e["score"].alias("relevance"),
            ),
        )

    return decided.select(
        "question_id",
        "document_id",
        "node_id",
        "intent",
        "question",
        "mode",
        F.col("r.answer").alias("answer"),
        F.col("r.confidence").alias("confidence"),
        F.col("r.refused").alias("refused"),
        F.col("r.refusal_reason").alias("refusal_reason"),
        cite(F.col("r.chunk_ids")).alias("citations"),
        F.transform(
            "r.quiz_items",
            lambda q: F.struct(
                q["question"].alias("question"), q["answer"].alias("answer"), cite(q["chunk_ids"]).alias("citations")
            ),
        ).alias("quiz_items"),
        F.col("context.truncated").alias("context_truncated"),
    )


def all_citation_ids(answer_ids: Column, quiz_ids: Column) -> Column:
    """Answer citations, then quiz citations that the answer lacks; repeats among quiz items stay."""
    return F.concat(answer_ids, F.filter(quiz_ids, lambda x: ~F.array_contains(answer_ids, x)))


def persist_answers(replies: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(states, links)``: the final state of every question and the evidence of the answered ones."""
    answer_ids = F.transform("citations", lambda c: c["chunk_id"])
    quiz_ids = F.flatten(F.transform("quiz_items", lambda q: F.transform(q["citations"], lambda c: c["chunk_id"])))
    from_model = F.col("mode") == MODE_MODEL
    states = replies.select(
        "question_id",
        "document_id",
        "node_id",
        "question",
        "intent",
        F.when(F.col("refused"), INSUFFICIENT).otherwise(ANSWERED).alias("status"),
        F.when(~F.col("refused"), F.col("answer")).alias("answer"),
        F.when(~F.col("refused") | ~from_model, F.col("mode")).alias("answer_mode"),
        F.when(from_model, F.lit(model)).cast("string").alias("model"),
        F.lit(A.PROMPT_VERSION).alias("prompt_version"),
        "confidence",
        F.when(F.col("refused"), F.col("refusal_reason")).alias("refusal_reason"),
        F.when(F.size("quiz_items") > 0, F.col("quiz_items")).alias("answer_payload"),
    )
    targets = replies.filter(~F.col("refused")).select(
        "document_id",
        F.col("question_id").alias("target_id"),
        all_citation_ids(answer_ids, quiz_ids).alias("chunk_ids"),
        F.get(F.transform("citations", lambda c: c["relevance"]), F.lit(0)).alias("__relevance"),
    )
    return states, make_links(targets, TARGET_ANSWER, relevance=F.col("__relevance"))


def answer_views(states: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with their live citations and quiz; a quiz citation falls back to its stored snapshot."""
    cited = citations(links, chunks, TARGET_ANSWER)
    citation = F.struct(
        "rank",
        "chunk_id",
        F.when(F.col("quote") != "", F.col("quote")).otherwise(F.col("chunk_text")).alias("quote"),
        "section_title",
        "chunk_index",
        "page_number",
        "paragraph_index",
        F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
    )
    listed = cited.groupBy(F.col("target_id").alias("question_id")).agg(
        F.sort_array(F.collect_list(citation)).alias("citations")
    )
    joined = states.join(listed, "question_id", "left").withColumn(
        "citations",
        F.coalesce(
            "citations",
            _none(
                "array<struct<rank:int,chunk_id:string,quote:string,section_title:string,chunk_index:int,"
                "page_number:int,paragraph_index:int,relevance:double>>"
            ),
        ),
    )

    def payload(snapshot: Column) -> Column:
        wanted = canonical_uuid(F.coalesce(snapshot["chunk_id"], F.lit("")))
        live = F.get(F.filter(F.col("citations"), lambda c: c["chunk_id"] == wanted), F.lit(0))
        quote = F.coalesce(snapshot["quote"], F.lit(""))
        live_text = live["quote"]
        return F.struct(
            F.coalesce(wanted, F.lit(ZERO_UUID)).alias("chunk_id"),
            F.when(quote != "", quote).otherwise(F.coalesce(live_text, F.lit(""))).alias("quote"),
            F.coalesce(live["section_title"], snapshot["section_title"], F.lit("")).alias("section_title"),
            F.coalesce(live["chunk_index"], F.lit(0)).alias("chunk_index"),
            live["page_number"].alias("page_number"),
            live["paragraph_index"].alias("paragraph_index"),
            F.coalesce(snapshot["relevance"], F.lit(0.0)).alias("relevance"),
        )

    quiz = F.transform(
        F.col("answer_payload"),
        lambda q: F.struct(
            F.coalesce(q["question"], F.lit("")).alias("question"),
            F.coalesce(q["answer"], F.lit("")).alias("answer"),
            F.transform(q["citations"], payload).alias("citations"),
        ),
    )
    kept = [c for c in joined.columns if c not in ("answer_payload", "citations")]
    return joined.select(*kept, "citations", quiz.alias("quiz_items"))

