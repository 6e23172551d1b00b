"""Context selection, quotes, quiz, citation guards, views and the job path from sections to answers."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartulary.config import Settings
from cartulary.functions import answers as X
from cartulary.operators import answers as A
from cartulary.operators import enrichment as R
from cartulary.operators import maintenance as M
from cartulary.operators import outline as O
from cartulary.operators import tree as T
from cartulary.plans.jobs import Store, answer, build_trees, index_documents
from cartulary.sources.store import current_states, read_states, read_store
from cartulary.sources.uploads import register_parsers

ITEM = "array<struct<label:string,chunk_id:string,text:string,location:string,section_title:string,score:double>>"


def item(n, text, score=0.7):
    return (f"c{n}", f"id{n}", text, "p.1", "S", score)


def fold(spark, evidence, column):
    return spark.createDataFrame([(evidence,)], f"e {ITEM}").select(column(F.col("e")).alias("x")).first()["x"]


def test_selection_skips_what_does_not_fit(spark):
    evidence = [item(1, "a" * 50), item(2, "b" * 500), item(3, "c" * 20)] + [item(n, "d") for n in range(4, 9)]
    got = fold(spark, evidence, lambda e: X.select_evidence(e, F.lit(10), Settings(context_max_characters=300)))
    assert [k["label"] for k in got["kept"]] == ["c1", "c3", "c4", "c5", "c6"] and got["dropped"] == 1
    assert got["used"] == 10 + 90 + 60 + 3 * 41


def test_quotes_stay_inside_the_budget(spark):
    got = fold(spark, [item(1, "First sentence. Second one is longer."), item(2, ""), item(3, "Third.")], lambda e: X.extractive_quotes(e, 20))
    assert got["quotes"] == ["First sentence.", "Third"] and got["chunk_ids"] == ["id1", "id3"]
    refused = fold(spark, [], A.extractive_result)
    assert refused["refused"] and refused["answer"] is None
    assert fold(spark, [item(1, "Enough.", 0.9)], A.extractive_result)["confidence"] == 0.5


def test_labels_resolve_once_and_only_when_known(spark):
    got = fold(spark, [item(1, "a"), item(2, "b")], lambda e: X.resolve_labels(F.array(*map(F.lit, [" C2 ", "c9", "c1", "c2"])), e))
    assert got == ["id2", "id1"]


def test_union_keeps_repeats_among_quiz_citations(spark):
    got = spark.range(1).select(A.all_citation_ids(F.array(F.lit("a")), F.array(*map(F.lit, "abb"))).alias("x")).first()["x"]
    assert got == ["a", "b", "b"]


def handbook(spark):
    rows = [
        ("d", 0, "Retrieval", 1, "Retrieval finds the evidence blocks that match a question. It ranks them by score."),
        ("d", 1, "Citations", 2, "Citations point from an answer to the evidence blocks it quotes."),
        ("d", 2, "Storage", 1, "Storage keeps documents and vectors side by side."),
        ("e", 0, "Blank", 1, "  "),
    ]
    sections = spark.createDataFrame(rows, "document_id string, section_index int, title string, level int, text string")
    titles = spark.createDataFrame([("d", "Handbook"), ("e", "Empty")], "document_id string, title string")
    return sections, titles


def test_jobs_from_sections_to_answers(spark, tmp_path):
    sections, titles = handbook(spark)
    store = Store(str(tmp_path / "store"))
    documents = titles.select("document_id")
    for _ in range(2):
        status = {r["document_id"]: r for r in index_documents(documents, sections, store).collect()}
    assert status["d"]["status"] == "indexed" and status["d"]["chunk_count"] == 3
    assert status["e"]["error_code"] == "processing_failed"
    assert read_store(spark, store.path("chunks")).count() == 3 and read_store(spark, store.path("vectors")).count() == 3

    only = titles.filter("document_id = 'd'")
    for _ in range(2):
        nodes = build_trees(only, sections.filter("document_id = 'd'"), store)
    stored = {r["path"]: r for r in read_store(spark, store.path("nodes")).collect()}
    assert {p: (r["title"], r["depth"], r["child_count"]) for p, r in stored.items()} == {
        "": ("Handbook", 0, 2),
        "0": ("Retrieval", 1, 1),
        "0.0": ("Citations", 2, 0),
        "1": ("Storage", 1, 0),
    }
    evidence = read_store(spark, store.path("evidence"))
    assert {r["target_type"]: r["n"] for r in evidence.groupBy("target_type").agg(F.count("*").alias("n")).collect()} == {"knowledge_node": 3 + 2 + 1 + 1, "knowledge_edge": 4}
    model = json.loads(read_store(spark, store.path("maps")).first()["map_model"])
    assert model["node_count"] == 4 and model["nodes_without_evidence"] == 0
    assert [e["target"] for e in model["edges"]] == ["0", "0.0", "1"]
    assert [c["title"] for c in model["root"]["children"]] == ["Retrieval", "Storage"]
    assert model["root"]["children"][0]["children"][0]["evidence_sections"] == [1]

    asked = [("q1", "0", "How are evidence blocks ranked?", "ask"), ("q2", "0", "test me", "quiz")]
    questions = spark.createDataFrame(asked, "question_id string, path string, question string, intent string").join(nodes.select("path", "node_id"), "path").drop("path")
    replies = {r["question_id"]: r for r in answer(questions, store).collect()}
    assert replies["q1"]["mode"] == "extractive_fallback" and "Retrieval finds" in replies["q1"]["answer"]
    assert replies["q1"]["citations"] and not replies["q1"]["refused"]
    assert [q["question"] for q in replies["q2"]["quiz_items"]] == ["请说明「Citations」的含义及其作用。"]
    answer(questions, store)
    links = read_store(spark, store.path("evidence")).filter("target_type = 'answer'")
    assert links.filter("target_id = 'q1'").count() == len(replies["q1"]["citations"])
    states = current_states(read_states(spark, store.path("question_states")))
    assert {r["question_id"]: r["status"] for r in states.collect()} == {"q1": "answered", "q2": "answered"}
    views = A.answer_views(states.drop("at"), links, read_store(spark, store.path("chunks")))
    view = views.filter("question_id = 'q2'").first()
    assert view["quiz_items"][0]["citations"][0]["section_title"] == "Retrieval"


def test_wide_parents_are_cut_with_everything_below(spark):
    rows = [("d", 0, "root", 1, "x")]
    for i in range(70):
        rows += [("d", 1 + 2 * i, f"s{i}", 2, "x"), ("d", 2 + 2 * i, f"t{i}", 3, "x")]
    sections = spark.createDataFrame(rows, "document_id string, section_index int, title string, level int, text string")
    placed = O.place_sections(sections)
    assert placed.count() == 1 + 64 * 2 and placed.filter("section_index > 128").count() == 0
    covered = {r["section_index"]: r["section_indexes"] for r in O.covered_sections(placed).collect()}
    assert covered[0] == list(range(24)) and covered[127] == [127, 128]
    wide = spark.createDataFrame([("w", i, str(i), 1, "x") for i in range(65)], sections.schema)
    assert O.tree_failures(wide).first()["top_level_sections"] == 65 and O.place_sections(wide).count() == 0


def test_search_is_case_insensitive_and_blank_finds_nothing(spark):
    sections, titles = handbook(spark)
    nodes = O.build_tree(sections.filter("document_id = 'd'"), titles)
    queries = spark.createDataFrame([(1, "d", " CITATIONS "), (2, "d", "  "), (3, "d", "vectors")], "query_id int, document_id string, query string")
    got = T.search(nodes, queries).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["path"]) for r in got] == [(1, "0.0"), (3, "1")]


def test_title_repairs_need_the_same_numbering_and_wording(spark):
    rows = [("内洒建设", "内涵建设"), ("一、内洒建设路径", "二、内涵建设路径"), ("数据平台建设", "完全不同标题"), ("同题", "同题"), ("短", "短题目很长很长")]
    pairs = spark.createDataFrame(rows, "title string, candidate string")
    assert [r["title"] for r in R.accepted_titles(pairs).collect()] == ["内洒建设"]


def test_reaper_is_strict_and_leaves_finished_jobs(spark):
    now = datetime(2024, 1, 1, 12)
    stale, edge, fresh = now - timedelta(hours=2), now - timedelta(seconds=1800), now - timedelta(minutes=5)
    rows = [("a", "indexing", "building", stale), ("b", "indexing", "none", edge), ("c", "indexed", "ready", stale), ("d", "indexing", "none", fresh)]
    documents = spark.createDataFrame(rows, "document_id string, status string, tree_status string, updated_at timestamp").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("error_code", "error_message", "tree_error")]
    )
    reaped = M.reap_documents(documents, now)
    assert {r["document_id"]: (r["status"], r["tree_status"]) for r in reaped.collect()} == {"a": ("failed", "failed"), "b": ("indexing", "none"), "c": ("indexed", "ready"), "d": ("indexing", "none")}


def test_late_failures_do_not_overwrite_answers(spark):
    log = spark.createDataFrame([("q", "queued", 1), ("q", "answered", 2), ("q", "failed", 3), ("r", "queued", 1), ("r", "running", 2)], "question_id string, status string, at int")
    assert {r["question_id"]: r["status"] for r in current_states(log).collect()} == {"q": "answered", "r": "running"}


def test_parser_registry_rejects_duplicates():
    with pytest.raises(ValueError):
        register_parsers([(".pdf", "a"), ("PDF", "b")])


def test_search_equals_a_scan(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcÄé知") for _ in range(rng.randint(1, 5)))
    rows = [(f"d{n % 3}", f"n{n}", " ".join(word() for _ in range(3)), " ".join(word() for _ in range(8)) if n % 5 else None, [word() for _ in range(n % 3)] if n % 7 else None, n) for n in range(150)]
    nodes = spark.createDataFrame(rows, "document_id string, node_id string, title string, summary string, keywords array<string>, preorder int")
    asked = [(f"q{n}", f"d{n % 4}", rng.choice(["", " "]) + "".join(rng.choice("abcÄé知 ") for _ in range(rng.randint(0, 4)))) for n in range(80)]
    queries = spark.createDataFrame(asked, "query_id string, document_id string, query string")
    want = set()
    for query, document, text in asked:
        needle = text.strip().lower()
        own = [r for r in rows if needle and r[0] == document and any(needle in (x or "").lower() for x in (r[2], r[3], *(r[4] or [])))]
        want |= {(query, r[1], rank + 1) for rank, r in enumerate(sorted(own, key=lambda r: r[5])[:20])}
    found = {(r["query_id"], r["node_id"], r["rank"]) for r in T.search(nodes, queries).collect()}
    assert found == want and len(want) > 100


def test_paths_from_parent_links(spark):
    """A chain of 300 nodes, a wide tree, a circle and a missing parent."""
    rng = random.Random(1)
    parents = {"n0": None} | {f"n{i}": f"n{i - 1}" for i in range(1, 300)} | {f"w{i}": rng.choice(["n0", *(f"w{j}" for j in range(i))]) for i in range(100)}
    rows = [("d", n, p, i % 50) for i, (n, p) in enumerate(parents.items())] + [("d", "x", "y", 0), ("d", "y", "x", 0), ("d", "lost", "none", 0), ("e", "n0", None, 3)]
    nodes = spark.createDataFrame(rows, "document_id string, node_id string, parent_id string, position int").repartition(4)
    found = {(r["document_id"], r["node_id"]): (r["path"], r["depth"], r["ancestors"]) for r in T.paths_from_parents(nodes).collect()}
    position, want = {n: p for d, n, _, p in rows if d == "d"}, {("e", "n0"): ("", 0, [])}
    for n in parents:
        chain, at = [], n
        while parents[at]:
            chain, at = [at, *chain], parents[at]
        want[("d", n)] = (".".join(str(position[x]) for x in chain), len(chain), (["n0", *chain])[:-1] if chain else [])
    assert found == want


def test_drafts_that_are_no_answers(spark):
    item = lambda q="q", a="a", n=1: (q, a, ["c1"] * n)
    rows = [
        ("fine", " ", ["c1"] * 8, 1.0, False, [item(n=6)] * 8), ("bare", "x", None, 0.0, None, None), ("long", "x" * 9000, [], 0.5, False, []),
        ("no answer", "", [], 0.5, False, []), ("null answer", None, [], 0.5, False, []), ("high", "x", [], 1.01, False, []), ("nan", "x", [], float("nan"), False, []),
        ("unsure", "x", [], None, False, []), ("labels", "x", ["c"] * 9, 0.5, False, []), ("items", "x", [], 0.5, False, [item()] * 9),
        ("question", "x", [], 0.5, False, [item(), item(q=None)]), ("reply", "x", [], 0.5, False, [item(a="")]), ("quoted", "x", [], 0.5, False, [item(n=7)]),
    ]
    kind = "question_id string, answer string, cited_evidence_ids array<string>, confidence double, insufficient_evidence boolean, quiz_items array<struct<question:string,answer:string,cited_evidence_ids:array<string>>>"
    found = {r["question_id"] for r in A.rejected_drafts(spark.createDataFrame(rows, kind)).collect()}
    assert found == {r[0] for r in rows[3:]}
