"""Chunking against a plain sequential reading, ids, alignment and the block scans."""

import random
import time
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.config import Settings
from cartulary.functions.chunking import block_spans, split_text, window_spans
from cartulary.functions.ids import CHUNK_NAMESPACE
from cartulary.operators.chunks import chunk_sections, chunks_aligned, document_status
from cartulary.operators.ordered import Carry, neighbour, running

LOCATIONS = "array<struct<page_number:int,paragraph_index:int>>"


def spans_of(spark, texts, size, overlap):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = frame.select("i", split_text(F.col("text"), size, overlap).alias("s")).orderBy("i").collect()
    return [[(s["start"], s["end"], s["text"]) for s in r["s"]] for r in rows]


def test_blocks_follow_blank_lines_and_all_line_breaks(spark):
    texts = ["a\n\nb c\n \t\nd\r\n\r\ne", "x\x0b\x0by z", "", "\n\n", "  lead\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [[(b["start"], b["end"]) for b in r["b"]] for r in frame.select("i", block_spans(F.col("text")).alias("b")).orderBy("i").collect()]
    assert got == [[(0, 1), (3, 6), (10, 11), (15, 16)], [(0, 2), (3, 6)], [], [], [(0, 6)]]


def test_windows_pack_blocks_without_overlap_and_cut_long_ones_with_it(spark):
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 250
    assert [(s, e) for s, e, _ in spans_of(spark, [text], 100, 20)[0]] == [(0, 62), (64, 164), (144, 244), (224, 314)]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n字", max_size=120), min_size=1, max_size=8), st.integers(5, 40), st.integers(0, 12))
def test_window_invariants(spark, texts, size, overlap):
    for text, spans in zip(texts, spans_of(spark, texts, size, overlap), strict=True):
        covered = set()
        for start, end, body in spans:
            assert 0 < end - start <= size and body == text[start:end].strip() and body
            covered.update(range(start, end))
        assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_chunk_indexes_run_over_sections_and_ids_are_stable(spark):
    rows = [("d", 0, "A", "x" * 25, [(None, None), (3, None)]), ("d", 1, "B", "  ", [(4, 0)]), ("d", 2, "C", "y", [(None, 7)])]
    sections = spark.createDataFrame(rows, f"document_id string, section_index int, title string, text string, source_locations {LOCATIONS}")
    small = Settings(chunk_max_characters=10, chunk_overlap_characters=3)
    got = chunk_sections(sections, small).orderBy("chunk_index").collect()
    assert [(r["section_index"], r["chunk_index"], r["char_start"], r["char_end"], r["page_number"], r["paragraph_index"]) for r in got] == [
        (0, 0, 0, 10, 3, None),
        (0, 1, 7, 17, 3, None),
        (0, 2, 14, 24, 3, None),
        (0, 3, 21, 25, 3, None),
        (2, 4, 0, 1, None, 7),
    ]
    assert [r["chunk_id"] for r in got] == [str(uuid.uuid5(uuid.UUID(CHUNK_NAMESPACE), f"d:{i}")) for i in range(5)]


def test_alignment_and_status(spark):
    sections = spark.createDataFrame([("a", 0, "T"), ("b", 0, "New")], "document_id string, section_index int, title string")
    chunks = spark.createDataFrame([("a", 0, "T", "m"), ("b", 0, "Old", "m")], "document_id string, section_index int, section_title string, embedding_model string")
    documents = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    assert {r["document_id"]: r["aligned"] for r in chunks_aligned(documents, sections, chunks).collect()} == {"a": True, "b": False, "c": False}
    assert {r["document_id"]: (r["chunk_count"], r["embedding_model"]) for r in document_status(documents, chunks).collect()} == {"a": (1, "m"), "b": (1, "m"), "c": (0, None)}


def test_block_scans_equal_one_pass(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([None, rng.randint(0, 9)])) for i in rng.sample(range(400), 150)]
    frame = spark.createDataFrame(rows, "document_id string, i int, v int")
    carries = [Carry("total", F.col("v"), "sum"), Carry("top", F.col("v"), "max"), Carry("low", F.col("v"), "min"), Carry("last", F.col("v"), "last")]
    for reverse in (False, True):
        got = {(r["document_id"], r["i"]): (r["total"], r["top"], r["low"], r["last"]) for r in running(frame, ["document_id"], "i", carries, reverse=reverse, block_rows=16).collect()}
        for key in "ab":
            seen = []
            for _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1] if reverse else r[1]):
                known = [x for x in seen if x is not None]
                want = (sum(known), max(known, default=None), min(known, default=None), known[-1] if known else None)
                assert got[(key, i)] == want
                seen.append(v)
    before = {(r["document_id"], r["i"]): r["p"] for r in neighbour(frame, ["document_id"], "i", F.col("v"), "p").collect()}
    for key in "ab":
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        assert [before[(key, r[1])] for r in ordered] == [None] + [r[2] for r in ordered[:-1]]


def _packed(text, size, overlap):
    """Spans of the windows by one pass over the blocks."""
    blocks, offset, opened, closed = [], 0, None, 0
    for line in text.splitlines(keepends=True):
        if line.strip():
            opened, closed = (offset if opened is None else opened), offset + len(line.rstrip("\r\n"))
        elif opened is not None:
            blocks.append((opened, closed))
            opened = None
        offset += len(line)
    if opened is not None:
        blocks.append((opened, closed))
    spans, window = [], None
    for start, end in blocks:
        if window and end - window[0] <= size:
            window = (window[0], end)
            continue
        if window:
            spans.append(window)
        while end - start > size:
            spans.append((start, start + size))
            start += size - overlap
        window = (start, end)
    return spans + [window] if window else spans


def test_windows_equal_one_pass_over_blocks(spark):
    rng = random.Random(4)
    texts = ["", "\n\n", "x", "a" * 500]
    for _ in range(120):
        paragraphs = ["\n".join("w" * rng.randint(1, 40) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 60))]
        texts.append("".join(p + rng.choice(["\n\n", "\n \n", "\n\n\n"]) for p in paragraphs))
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(4)
    for size, overlap in ((30, 0), (50, 20), (200, 60)):
        spans = window_spans(block_spans(F.col("text")), size, overlap)
        for r in frame.select("n", spans.alias("spans")).collect():
            assert [tuple(s) for s in r["spans"]] == _packed(texts[r["n"]], size, overlap)


def test_work_grows_with_the_length(spark):
    seconds = []
    for count in (20_000, 80_000):
        text = F.repeat(F.lit("a paragraph of some words\n\n"), count)
        frame = spark.range(1).select(split_text(F.concat(text, F.col("id").cast("string")), 900, 150).alias("chunks"))
        started = time.perf_counter()
        assert frame.select(F.size("chunks")).first()[0] == len(_packed("a paragraph of some words\n\n" * count + "0", 900, 150))
        seconds.append(time.perf_counter() - started)
    assert seconds[1] < 12 * seconds[0]
    print(seconds)
