"""Bounded selection and quoting as folds over short arrays, and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.text import collapse, let, strip

# Intents, their default questions, retrieval hints and instructions, and message texts.
INTENTS = ("explain", "example", "deep_dive", "quiz", "ask")
DEFAULT_QUESTIONS = {
    "explain": "请解释这个节点。",
    "example": "请举例说明这个节点。",
    "deep_dive": "我想深入学习这个节点。",
    "quiz": "请根据这个节点生成测试问题。",
    "ask": "",
}
QUERY_HINTS = {
    "explain": "定义 含义 是什么 为什么重要",
    "example": "案例 例如 示例 比如 典型",
    "deep_dive": "要点 展开 关联 影响 路径",
    "quiz": "定义 事实 数据 要点",
}
INTENT_INSTRUCTIONS = {
    "explain": "Explain this node to someone who has never read the document: what it is, why it matters, and how it relates to its parent and sibling nodes. Start from the node's definition when the context contains one. Keep it to a few short paragraphs.",
    "example": "Illustrate this node with examples. Prefer examples, cases or numbers that appear in the context (look for 案例 / 例如 / 比如 / 示例). If the context contains none, say so explicitly and mark any illustration you add as 示意（非文档内容）.",
    "deep_dive": "Help the reader study this node in depth: break it into its sub-points, explain how they relate, and end with what to read next inside this document (child nodes or nearby sections).",
    "quiz": "Write 3-5 test questions that check understanding of this node, from factual recall to application. Each question must be answerable from the context alone. Put every question with its reference answer into quiz_items, and keep the main answer to a one-sentence introduction.",
    "ask": "Answer the user's question using only the context.",
}
PROMPT_VERSION = "node-assistant-v1"
NAMED_CHILDREN = 6
SENTENCE_BREAK = r"(?<=[.!?。！？])\s*"
EVIDENCE_OVERHEAD = 40
REFUSED_NO_MATCH = "No content block in this document matched the request closely enough."
REFUSED_NO_TEXT = "The retrieved content blocks contained no quotable text."
REFUSED_INSUFFICIENT = "The node context does not contain the information needed for this request."
REFUSED_UNTRACED = "The answer could not be traced to any retrieved content block."


def _lookup(values: dict[str, str], key: Column) -> Column:
    chain = None
    for name, text in values.items():
        chain = F.when(key == name, text) if chain is None else chain.when(key == name, text)
    return F.coalesce(chain, F.lit(""))


def normalize_intent(value: Column) -> Column:
    return F.when(value.isin(*INTENTS), value).otherwise(F.lit("ask"))


def default_question(intent: Column) -> Column:
    return _lookup(DEFAULT_QUESTIONS, intent)


def query_hint(intent: Column) -> Column:
    return _lookup(QUERY_HINTS, intent)


def retrieval_query(
    title: Column, summary: Column, intent: Column, question: Column, child_titles: Column, limit: int
) -> Column:
    """Non-empty parts on lines of their own; a deep dive also names the first six children."""
    named = F.when(intent == "deep_dive", F.slice(child_titles, 1, NAMED_CHILDREN)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(title, summary, query_hint(intent), question), named)
    filled = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.substring(strip(F.array_join(filled, "\n")), 1, limit)


def select_evidence(evidence: Column, fixed_cost: Column, settings: Settings = DEFAULTS) -> Column:
    """``struct<used, kept, dropped>``: of the first six items those that fit; one too long is skipped over."""
    item_type = "array<struct<label:string,chunk_id:string,text:string,location:string,section_title:string,score:double>>"
    start = F.struct(
        fixed_cost.cast("int").alias("used"),
        F.array().cast(item_type).alias("kept"),
        F.lit(0).alias("dropped"),
    )

    def step(acc: Column, item: Column) -> Column:
        cost = F.length(item["text"]) + EVIDENCE_OVERHEAD
        fits = acc["used"] + cost <= settings.context_max_characters
        return F.when(
            fits,
            F.struct(
                (acc["used"] + cost).alias("used"),
                F.array_append(acc["kept"], item).alias("kept"),
                acc["dropped"].alias("dropped"),
            ),
        ).otherwise(
            F.struct(acc["used"].alias("used"), acc["kept"].alias("kept"), (acc["dropped"] + 1).alias("dropped"))
        )

    return F.aggregate(F.slice(evidence, 1, settings.context_evidence_items), start, step)


def leading_sentences(text: Column, budget: Column) -> Column:
    """Whole text when it fits, else its first sentences up to the budget, at least one."""

    def choose(clean: Column) -> Column:
        pieces = F.filter(F.split(clean, f"(?U){SENTENCE_BREAK}"), lambda s: s != "")
        start = F.struct(
            F.array().cast("array<string>").alias("taken"), F.lit(0).alias("length"), F.lit(False).alias("done")
        )

        def step(acc: Column, sentence: Column) -> Column:
            over = (acc["length"] + F.length(sentence) > budget) & (F.size(acc["taken"]) > 0)
            length = acc["length"] + F.length(sentence)
            return F.when(
                acc["done"] | over,
                F.struct(acc["taken"].alias("taken"), acc["length"].alias("length"), F.lit(True).alias("done")),
            ).otherwise(
                F.struct(
                    F.array_append(acc["taken"], sentence).alias("taken"),
                    length.alias("length"),
                    (length >= budget).alias("done"),
                )
            )

        joined = F.trim(F.aggregate(pieces, start, step, lambda acc: F.array_join(acc["taken"], " ")))
        return F.when(F.length(clean) <= budget, clean).when(joined != "", joined).otherwise(
            F.trim(F.substring(clean, F.lit(1), budget))
        )

    return let(collapse(text), choose)


def extractive_quotes(evidence: Column, budget: int) -> Column:
    """``struct<remaining, quotes, chunk_ids>``: verbatim quotes across the evidence within one budget."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(budget).alias("remaining"), empty.alias("quotes"), empty.alias("chunk_ids"))

    def step(acc: Column, item: Column) -> Column:
        excerpt = F.trim(F.substring(leading_sentences(item["text"], acc["remaining"]), F.lit(1), acc["remaining"]))

        def add(quote: Column) -> Column:
            return F.when((acc["remaining"] <= 0) | (quote == ""), acc).otherwise(
                F.struct(
                    (acc["remaining"] - F.length(quote)).alias("remaining"),
                    F.array_append(acc["quotes"], quote).alias("quotes"),
                    F.array_append(acc["chunk_ids"], item["chunk_id"]).alias("chunk_ids"),
                )
            )

        return F.when(acc["remaining"] <= 0, acc).otherwise(let(excerpt, add))

    return F.aggregate(evidence, start, step)


def resolve_labels(labels: Column, evidence: Column) -> Column:
    """Chunk ids of the cited labels that exist, first mention only; a missing list cites nothing."""
    found = F.transform(
        F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(strip(x))),
        lambda x: F.get(F.filter(evidence, lambda e: e["label"] == x), F.lit(0))["chunk_id"],
    )
    return F.array_distinct(F.array_compact(found))


def render_context(context: Column) -> Column:
    """Prompt block of one context struct."""

    def filled(condition: Column, text: Column) -> Column:
        return F.when(condition, text)

    c = context
    children = F.array_join(
        F.transform(
            c["children"],
            lambda x: F.concat(F.lit("- "), x["title"], F.lit(": "), F.substring(x["summary"], 1, 120)),
        ),
        "\n",
    )
    evidence = F.array_join(
        F.transform(
            c["evidence"],
            lambda e: F.concat(
                F.lit("[Evidence "),
                e["label"],
                F.lit(" | "),
                e["location"],
                F.lit(' | section="'),
                e["section_title"],
                F.lit('"]\n'),
                e["text"],
            ),
        ),
        "\n",
    )
    note = F.concat(
        F.lit("Context truncated: dropped "),
        c["dropped_evidence"].cast("string"),
        F.lit(" evidence blocks"),
        F.when(
            c["dropped_children"] > 0,
            F.concat(F.lit(" and "), c["dropped_children"].cast("string"), F.lit(" child summaries")),
        ).otherwise(F.lit("")),
        F.lit(". Say so if the answer may be incomplete."),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Document: "), c["document_title"]),
        filled(F.size(c["breadcrumb"]) > 0, F.concat(F.lit("Outline path: "), F.array_join(c["breadcrumb"], " > "))),
        F.concat(F.lit("Node: "), c["node_title"]),
        filled(F.size(c["keywords"]) > 0, F.concat(F.lit("Node keywords: "), F.array_join(c["keywords"], ", "))),
        filled(c["node_summary"] != "", F.concat(F.lit("Node summary: "), F.substring(c["node_summary"], 1, 600))),
        filled(F.size(c["children"]) > 0, F.concat(F.lit("Child nodes:\n"), children)),
        filled(
            F.size(c["siblings"]) > 0,
            F.concat(F.lit("Sibling nodes (for contrast): "), F.array_join(c["siblings"], ", ")),
        ),
        F.lit("Evidence blocks (cite them by label):"),
        filled(F.size(c["evidence"]) > 0, evidence),
        filled(c["truncated"], note),
    )


def assistant_prompt(context: Column, intent: Column, question: Column) -> Column:
    asked = F.trim(F.coalesce(question, F.lit("")))
    return F.concat_ws(
        "\n\n",
        F.lit(f"Prompt version: {PROMPT_VERSION}"),
        F.concat(F.lit("Task: "), intent),
        _lookup(INTENT_INSTRUCTIONS, intent),
        F.when(asked != "", F.concat(F.lit("User question: "), asked)),
        F.concat(F.lit("Node Context:\n<context>\n"), render_context(context), F.lit("\n</context>")),
    )
