"""The pipeline's stages on a small corpus, each held against what it must do."""

import random

import corpus_pipeline
from cartulary.session import settle

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    names, rows = docs.columns, docs.count()
    rng = random.Random(4)
    passage = " ".join(f"passage{rng.randint(0, 10**6)}" for _ in range(52))
    base = [r for r in docs.join(labels, "doc_id").where("n_chars between 400 and 900 and lang = 'en' and quality = 1").select(docs.columns).orderBy("doc_id").collect()]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    mixed = base[2]["text"].split()
    rng.shuffle(mixed)
    mixed = " ".join(mixed)
    planted = [(1000, base[0]["text"]), (1001, base[1]["text"] + " " + passage), (1002, passage + " " + mixed), (1003, "Then " + item)]
    extra = spark.createDataFrame([(d, t, "en", "plant", len(t)) for d, t in planted], docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER))
        kept[name] = docs
        if name != "sequences":
            assert docs.columns == names
    assert rows * 0.6 < kept["quality"].count() <= rows + 4
    assert 1000 not in {r[0] for r in kept["near_duplicates"].select("doc_id").collect()}
    assert kept["near_duplicates"].where(f"contains(text, '{passage[:300]}')").count() == 2
    assert not kept["repeated_passages"].where(f"contains(text, '{passage[:300]}')").count()
    assert not kept["benchmark_leaks"].where("doc_id = 1003").count()
    assert kept["sequences"].select("doc_id").distinct().count() == kept["benchmark_leaks"].count()


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_passage_of_51_short_words(spark):
    rng = random.Random(9)
    fill = lambda n: " ".join(f"{rng.randint(0, 10**9)}" for _ in range(n))
    letters = " ".join(rng.choice("abcdefghij") for _ in range(51))
    phrase = " ".join(f"phrase{rng.randint(10**5, 10**6)}" for _ in range(9))
    assert len(letters) == 101 and 101 < len(phrase) < 200
    texts = [f"{fill(20)} {part} {fill(30)}" for part in (letters, letters, phrase, phrase, fill(3))]
    docs = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    kept = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, FOLDER).collect()}
    assert all(letters not in kept[n]["text"] and kept[n]["n_chars"] == len(kept[n]["text"]) < len(texts[n]) - 100 for n in (0, 1))
    assert [kept[n]["text"] for n in (2, 3, 4)] == texts[2:]
    assert kept[0]["text"].split() == texts[0].split()[:20] + texts[0].split()[71:]
