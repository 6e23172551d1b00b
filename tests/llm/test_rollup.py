"""Delta-kept totals against recounting, idempotent and half-written batches."""

import random
from collections import Counter

import public_tokenizers
import pytest

from cartulary.llm.queries import op9_token_rollup
from cartulary.llm.rollup import Rollup, bpe_counter, count_tokens, documents_history, word_counter

CHANGES = "doc_id long, tokenizer string, source string, lang string, n_tokens long, action string, change long, extra string"


def test_random_batches_equal_recount(spark, tmp_path):
    rng, book, state = random.Random(2), Rollup(spark, str(tmp_path / "book")), {}
    assert book.totals().count() == 0
    for number in range(5):
        rows = [
            (rng.choice([None, *range(30)]), rng.choice(("v1", "v2")), rng.choice(("a", "b", None)), rng.choice(("en", None)), rng.choice((None, 0, 5, 9)), rng.choice(("put", "put", "delete")), n, "x")
            for n in range(40 * (number != 3))
        ]
        frame = spark.createDataFrame(rows, CHANGES).repartition(3)
        assert book.commit(f"b{number}", frame)
        assert not book.commit(f"b{number}", frame)
        for doc, tokenizer, source, lang, tokens, action, _, _ in rows:
            if doc is not None:
                state[(doc, tokenizer)] = (source, lang, tokens or 0) if action == "put" else None
        expected = Counter()
        for (_, tokenizer), value in state.items():
            if value:
                expected[(value[0], value[1], tokenizer, "docs")] += 1
                expected[(value[0], value[1], tokenizer, "tokens")] += value[2]
        found = Counter()
        for r in Rollup(spark, str(tmp_path / "book")).totals().collect():
            found[(r["source"], r["lang"], r["tokenizer"], "docs")] += r["n_docs"]
            found[(r["source"], r["lang"], r["tokenizer"], "tokens")] += r["n_tokens"]
        assert +found == +expected
    before = book.totals().count()
    (tmp_path / "book" / "entries" / "000000000009-half").mkdir()
    assert book.totals().count() == before
    with pytest.raises(ValueError):
        book.commit("a/b", frame)


def test_query_equals_recount(spark):
    folder = "/root/testdata/sf0.001"
    expected = Counter()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    counters = {"words-1": word_counter(), "bytes-bpe-50k": bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()}
    for name, count in counters.items():
        for r, n in zip(docs, count([r["text"] for r in docs])):
            expected[(r["source"], r["lang"], name)] += n
    assert {(r["source"], r["lang"], r["tokenizer"]): r["n_tokens"] for r in op9_token_rollup(spark, folder).collect()} == dict(expected)


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, 3), (None, "a b", "s", "en", 3), (2, "", "s", "en", 3)], "doc_id long, text string, source string, lang string, n_tokens long")
    assert sorted(r["n_tokens"] for r in count_tokens(docs, "w", word_counter).collect()) == [0, 0, 2]


def test_history_ends_with_every_row(spark, tmp_path):
    rows = [(n, "a b c"[: 1 + n % 5], "s" if n % 3 else None, "en") for n in range(-6, 13)]
    rows += [(None, "a b", "s", "en"), (None, None, "s", "en"), (2, "a b c d", "s", "en"), (2, "a b c d", "s", "en"), (4, "a", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    expected = Counter()
    for _, text, source, lang in rows:
        for name in ("v1", "v2"):
            expected[(source, lang, name, "docs")] += 1
            expected[(source, lang, name, "tokens")] += len((text or "").split())
    found = Counter()
    for r in documents_history(docs, {"v1": word_counter, "v2": word_counter}, str(tmp_path / "book")).collect():
        found[(r["source"], r["lang"], r["tokenizer"], "docs")] += r["n_docs"]
        found[(r["source"], r["lang"], r["tokenizer"], "tokens")] += r["n_tokens"]
    assert found == expected


def test_query_counts_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    expected = {(r["source"], r["lang"]): r["count"] for r in spark.read.parquet(f"{folder}/documents.parquet").groupBy("source", "lang").count().collect()}
    for name in ("words-1", "bytes-bpe-50k"):
        assert {(r["source"], r["lang"]): r["n_docs"] for r in op9_token_rollup(spark, folder).collect() if r["tokenizer"] == name} == expected
