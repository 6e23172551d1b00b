"""Token counts by source, language and tokenizer version, kept by signed deltas.

A batch says what happened to documents: ``put`` (inserted or revised) or ``delete``. Against the entries that are
stored, each change becomes signed rows: the old count leaves its group, the new one enters its own. A batch is stored
as one folder of entries and one of deltas under a name that is only its own, and is committed by renaming a marker file
last; readers see committed batches alone, so a batch that failed half-way leaves nothing and a repeated one does
nothing. Totals are the sum of all deltas; nothing is recounted.

Counts come with the rows or from ``count_tokens``; both are additive, so any tokenizer version can be added later.

Defined cases: a null text counts no tokens; a null source or language is a group of its own; rows without a doc_id or
tokenizer version are not counted; of several changes to one document and version in a batch the one with the highest
``change`` number stands, ties go to the largest count; deleting what is not there changes nothing; an empty batch is
committed and changes nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.session import settle

KEYS = ("source", "lang", "tokenizer")
_ENTRY = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, sequence long"
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


class Rollup:
    """Committed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def committed(self) -> list[tuple[int, str]]:
        """(sequence, batch) of the committed batches, in order; there is one small file a batch."""
        marks = self._path("commits")
        if not self.files.exists(marks):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(marks)]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if "-" in n and not n.startswith("."))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{n:012d}-{b}" for n, b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The latest committed entry of each document and version, with the deleted ones."""
        latest = F.max(F.struct("sequence", "alive", "source", "lang", "n_tokens")).alias("e")
        return self._read("entries", _ENTRY).groupBy("doc_id", "tokenizer").agg(latest).select("doc_id", "tokenizer", "e.*")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all groups that hold documents."""
        sums = self._read("deltas", _DELTA).groupBy(*KEYS).agg(F.sum("documents").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0").select(*KEYS, "n_docs", "n_tokens")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes(doc_id, tokenizer, source, lang, n_tokens, action, change)``; False if it was there already."""
        if not batch or any(c in batch for c in "/-:"):
            raise ValueError(f"batch name: {batch!r}")
        done = self.committed()
        if batch in {name for _, name in done}:
            return False
        sequence = done[-1][0] + 1 if done else 0
        named = f"{sequence:012d}-{batch}"
        own = changes.where("doc_id is not null and tokenizer is not null").select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("tokenizer").cast("string").alias("tokenizer"),
            F.struct(
                F.coalesce(F.col("change").cast("long"), F.lit(0)).alias("change"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
                F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.col("action") == "put").alias("alive"),
            ).alias("new"),
        ).groupBy("doc_id", "tokenizer").agg(F.max("new").alias("new"))
        stored = self.entries().select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens", "alive").alias("old"))
        entry = own.select("doc_id", "tokenizer", "new.source", "new.lang", "new.n_tokens", F.coalesce("new.alive", F.lit(False)).alias("alive"), F.lit(sequence).cast("long").alias("sequence"))
        entry.write.mode("overwrite").parquet(f"{self.folder}/entries/{named}")
        written = self.spark.read.schema(_ENTRY).parquet(f"{self.folder}/entries/{named}")
        leaving = written.select("doc_id", "tokenizer").join(stored, ["doc_id", "tokenizer"]).where("old.alive").select(
            "old.source", "old.lang", "tokenizer", F.lit(-1).cast("long").alias("documents"), (-F.col("old.n_tokens")).alias("tokens")
        )
        entering = written.where("alive").select("source", "lang", "tokenizer", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"))
        signed = entering.unionByName(leaving).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        signed.where("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/deltas/{named}")
        self.files.mkdirs(self._path("commits"))
        mark = self._path("commits", f".{named}")
        self.files.create(mark, True).close()
        if not self.files.rename(mark, self._path("commits", named)):
            raise RuntimeError(f"batch {batch} could not be committed")
        return True


Encoder = Callable[[], Callable[[list[str]], list[int]]]


def word_counter() -> Callable[[list[str]], list[int]]:
    """Words between white space."""
    return lambda texts: [len(t.split()) for t in texts]


def bpe_counter(file: str, pattern: str) -> Encoder:
    """Tokens of a byte-level BPE given as ranks; special tokens are ordinary text."""

    def make() -> Callable[[list[str]], list[int]]:
        import base64

        import tiktoken

        with open(file, "rb") as source:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]

    return make


def count_tokens(docs: DataFrame, tokenizer: str, encoder: Encoder) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder()
        for batch in batches:
            sizes = count([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], batch["lang"], pa.array([tokenizer] * len(sizes), pa.string()), pa.array(sizes, pa.int64())],
                ["doc_id", "source", "lang", "tokenizer", "n_tokens"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    return own.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def documents_history(docs: DataFrame, encoders: dict[str, Encoder], folder: str) -> DataFrame:
    """The totals of ``docs`` after five batches, two of them committed twice; they equal a recount of all rows.

    Every row of the table is a document of its own, also where it repeats a ``doc_id`` or has none, so entries are
    kept by a row number. All rows enter with every tokenizer version; those of even id are withdrawn; those divisible
    by four come back with one token more under the source 'revised', and return to their own source and count; last,
    the other withdrawn rows are put back.
    """
    counted = None
    for name, encoder in encoders.items():
        part = count_tokens(docs, name, encoder)
        counted = part if counted is None else counted.unionByName(part)
    counted = settle(counted.withColumnRenamed("doc_id", "id").withColumn("doc_id", F.monotonically_increasing_id()))
    put, delete = (counted.withColumn("action", F.lit(a)).withColumn("change", F.lit(0)) for a in ("put", "delete"))
    book = Rollup(docs.sparkSession, folder)
    fourth = put.where("id % 4 = 0")
    for name, changes in (
        ("inserts", put), ("inserts", put), ("deletes", delete.where("id % 2 = 0")), ("deletes", delete.where("id % 2 = 0")),
        ("revised", fourth.withColumn("source", F.lit("revised")).withColumn("n_tokens", F.col("n_tokens") + 1)), ("returned", fourth),
        ("restored", put.where("id % 2 = 0 and id % 4 <> 0")),
    ):
        book.commit(name, changes)
    return book.totals()
