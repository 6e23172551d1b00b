"""Citations with missing lists, outlines deeper than nine levels, wide documents, and stores that run empty."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartulary.functions.answers import resolve_labels
from cartulary.operators.outline import outline_parents, subtree_ends, tree_status
from cartulary.sources.store import Conflict, Transaction, compact, delete_documents, read_store, replace_documents, upsert

EVIDENCE = "labels array<string>, evidence array<struct<label:string,chunk_id:string>>"


def test_labels_with_other_blanks_and_missing_lists(spark):
    held = [("c1", "x"), ("c2", "y")]
    rows = [(["c1\n", " C2\t", "c9"], held), (None, held), ([None], held)]
    found = spark.createDataFrame(rows, EVIDENCE).select(resolve_labels(F.col("labels"), F.col("evidence")).alias("ids")).collect()
    assert [r["ids"] for r in found] == [["x", "y"], [], []]


def test_levels_beyond_nine(spark):
    rows = [("d", i, 3 * i + 1) for i in range(12)] + [("d", 12, 2), ("e", 0, 40), ("e", 1, 7)]
    frame = spark.createDataFrame(rows, "document_id string, section_index int, level int")
    parents = {(r["document_id"], r["section_index"]): (r["parent_index"], r["ancestors"]) for r in outline_parents(frame).collect()}
    assert all(parents[("d", i)] == (i - 1, list(range(i))) for i in range(1, 12))
    assert parents[("d", 12)] == (0, [0]) and parents[("e", 0)] == parents[("e", 1)] == (None, [])
    ends = {(r["document_id"], r["section_index"]): r["subtree_end"] for r in subtree_ends(frame).collect()}
    assert ends[("d", 0)] is None and ends[("d", 5)] == 12 and ends[("e", 0)] == 1
    assert outline_parents(frame.limit(0)).count() == 0


def test_wide_documents_are_failed(spark):
    rows = [("wide", i, 1) for i in range(70)] + [("fine", i, 1) for i in range(64)]
    frame = spark.createDataFrame(rows, "document_id string, section_index int, level int")
    titles = spark.createDataFrame([("wide",), ("fine",), ("none",)], "document_id string")
    found = {r["document_id"]: (r["status"], r["kept_sections"]) for r in tree_status(titles, frame).collect()}
    assert found == {"wide": ("failed", 0), "fine": ("ready", 64), "none": ("ready", 0)}


def test_store_that_runs_empty(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, n int")
    replace_documents(rows.limit(0), path)
    assert read_store(spark, path).count() == 0
    replace_documents(rows, path)
    delete_documents(spark, path, rows)
    assert read_store(spark, path).count() == 0
    replace_documents(rows, path)
    assert sorted(tuple(r) for r in read_store(spark, path).collect()) == [("a", 1), ("b", 2)]


def test_outlines_of_any_levels_equal_a_stack(spark):
    """Random levels, a chain of 1,000 levels and back, and levels in pairs."""
    rng = random.Random(2)
    documents = {"random": [rng.randint(-2, 12) for _ in range(700)], "deep": [*range(1, 1001), *range(999, 0, -3)], "pairs": [n // 2 % 7 for n in range(40)], "lone": [5]}
    rows = [(name, 3 * n + 1, level) for name, levels in documents.items() for n, level in enumerate(levels)]
    frame = spark.createDataFrame(rows, "document_id string, section_index int, level int").repartition(5)
    parents = {(r["document_id"], r["section_index"]): r for r in outline_parents(frame).collect()}
    ends = {(r["document_id"], r["section_index"]): r["subtree_end"] for r in subtree_ends(frame).collect()}
    for name, levels in documents.items():
        stack, want_ends = [], {}
        for n, level in enumerate(max(1, x) for x in levels):
            while stack and stack[-1][1] >= level:
                want_ends[stack.pop()[0]] = 3 * n + 1
            own = parents[(name, 3 * n + 1)]
            assert own["ancestors"] == [at for at, _ in stack] and own["parent_index"] == (stack[-1][0] if stack else None)
            stack.append((3 * n + 1, level))
        assert all(ends[(name, 3 * n + 1)] == want_ends.get(3 * n + 1) for n in range(len(levels)))


def _rows(spark, path):
    return sorted(tuple(r) for r in read_store(spark, path).collect())


def test_commits_over_several_tables(spark, tmp_path):
    root = str(tmp_path / "root")
    frame = lambda *rows: spark.createDataFrame(list(rows), "document_id string, n int")
    first = Transaction(spark, root)
    first.replace(frame(("a", 1), ("a", 2), ("b", 1)), "left")
    first.replace(frame(("a", 10)), "right")
    first.commit()
    broken = Transaction(spark, root)  # stops between its tables
    broken.replace(frame(("a", 3)), "left")
    broken.remove("right", frame(("a", 0)))
    assert _rows(spark, f"{root}/left") == [("a", 1), ("a", 2), ("b", 1)] and _rows(spark, f"{root}/right") == [("a", 10)]
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "root" / "left").rglob("*.parquet")}
    second = Transaction(spark, root)
    second.replace(frame(("a", 4)), "left")
    second.remove("right", frame(("a", 0)))
    with pytest.raises(ValueError):
        second.replace(frame(("a", 5)), "left")
    assert second.commit() == 2
    assert _rows(spark, f"{root}/left") == [("a", 4), ("b", 1)] and _rows(spark, f"{root}/right") == []
    assert all(Path(p).stat().st_mtime_ns == at for p, at in before.items())  # no other document is rewritten
    late = Transaction(spark, root)
    late.replace(frame(("b", 7)), "left")
    with pytest.raises(Conflict):
        late.commit(after=1)
    assert late.commit() == 3
    compact(spark, f"{root}/left")
    assert _rows(spark, f"{root}/left") == [("a", 4), ("b", 7)] and _rows(spark, f"{root}/right") == []
    delete_documents(spark, f"{root}/left", frame(("a", 0)))
    replace_documents(frame(("a", 8)), f"{root}/left")
    assert _rows(spark, f"{root}/left") == [("a", 8), ("b", 7)]


def test_replaced_kinds_and_keys(spark, tmp_path):
    path = str(tmp_path / "evidence")
    frame = lambda *rows: spark.createDataFrame(list(rows), "document_id string, kind string, n int")
    replace_documents(frame(("a", "node", 1), ("a", "edge", 2), ("a", None, 3), ("b", "node", 4)), path)
    replace_documents(frame(("a", "node", 5)), path, within=("kind", ("node", "answer")))
    assert sorted(read_store(spark, path).collect(), key=str) == sorted(frame(("a", "node", 5), ("a", "edge", 2), ("a", None, 3), ("b", "node", 4)).collect(), key=str)
    upsert(frame(("b", "x", 4), ("b", "y", 9)), path, "n")
    upsert(frame(("b", "z", 9)), path, "n")
    assert {tuple(r) for r in read_store(spark, path).where("document_id = 'b'").collect()} == {("b", "x", 4), ("b", "z", 9)}
