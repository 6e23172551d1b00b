"""Stored tables under one root: versioned rows, commits over several tables, keyed reads and an append-only state log.

A transaction writes new rows, and what they replace, into folders of its own; nothing that is stored is touched. One
small commit record then makes all its tables visible at once. Readers take the rows of committed transactions that no
later one replaced. So a changed document rewrites no other, and after a crash between two tables the old state is seen.

A table may be rewritten as one transaction from time to time (``compact``).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.window import Window

from cartulary.session import settle

_COMMITS = "_commits"
_COMMIT = "seq long, txn string, resets array<string>"
_TXN, _SEQ = "txn", "__seq"


class Conflict(RuntimeError):
    """Another transaction was committed first."""


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _exists(spark: SparkSession, path: str) -> bool:
    system, found = _files(spark, path)
    return system.exists(found)


def _commits(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/{_COMMITS}"
    if not _exists(spark, folder):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).option("pathGlobFilter", "*.json").json(folder)


def _last(spark: SparkSession, root: str) -> int:
    """Number of the latest commit, 0 before the first one."""
    system, folder = _files(spark, f"{root}/{_COMMITS}")
    if not system.exists(folder):
        return 0
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    return max([int(n.split(".")[0]) for n in names if n.endswith(".json")], default=0)


class Transaction:
    """Changes of several tables that become visible together, or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.id = spark, root.rstrip("/"), uuid.uuid4().hex
        self.tables: set[str] = set()

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _add(self, rows: DataFrame, table: str) -> None:
        if table in self.tables:
            raise ValueError(f"{table} is changed twice in one transaction")
        self.tables.add(table)
        if not _exists(self.spark, f"{self._path(table)}.schema"):
            described = self.spark.createDataFrame([(rows.schema.json(),)], "value string")
            described.coalesce(1).write.mode("overwrite").text(f"{self._path(table)}.schema")
        rows.write.parquet(f"{self._path(table)}/{_TXN}={self.id}")

    def _retire(self, gone: DataFrame, table: str) -> None:
        gone.write.parquet(f"{self._path(table)}.retired/{_TXN}={self.id}")

    def replace(
        self, rows: DataFrame, table: str, documents: DataFrame | None = None, *, within: tuple[str, Iterable[str]] | None = None
    ) -> None:
        """Replace all stored rows of ``documents`` (by default those of ``rows``) by ``rows``.

        ``within`` names a column and the values of it that are replaced, for example kinds of evidence. Documents
        without new rows lose their old ones.
        """
        gone = (rows if documents is None else documents).select("document_id").distinct()
        column, values = within or (None, (None,))
        listed = F.explode(F.array(*[F.lit(v).cast("string") for v in values]))
        self._add(rows, table)
        self._retire(gone.select("document_id", F.lit(column).cast("string").alias("by"), listed.alias("value")), table)

    def upsert(self, rows: DataFrame, table: str, key: str) -> None:
        """Insert rows or replace those of the same ``key``; other rows of the document stay."""
        self.replace_targets(rows, table, rows, key)

    def replace_targets(self, rows: DataFrame, table: str, targets: DataFrame, key: str = "target_id") -> None:
        """Replace the rows of ``targets(document_id, key)`` by ``rows``."""
        self._add(rows, table)
        self._retire(targets.select("document_id", F.lit(key).alias("by"), F.col(key).cast("string").alias("value")).distinct(), table)

    def remove(self, table: str, documents: DataFrame) -> None:
        """Remove all rows of ``documents``, if the table exists."""
        if _exists(self.spark, f"{self._path(table)}.schema"):
            none = F.lit(None).cast("string")
            self._retire(documents.select("document_id").distinct().select("document_id", none.alias("by"), none.alias("value")), table)

    def commit(self, *, resets: Iterable[str] = (), after: int | None = None) -> int:
        """Make the changes visible; returns the commit's number. ``after`` fails if another commit came in between."""
        while True:
            number = (_last(self.spark, self.root) if after is None else after) + 1
            record = json.dumps({"seq": number, "txn": self.id, "resets": sorted(resets)})
            system, path = _files(self.spark, f"{self.root}/{_COMMITS}/{number:012d}.json")
            staged = _files(self.spark, f"{self.root}/{_COMMITS}/.{self.id}")[1]
            stream = system.create(staged, True)
            stream.write(bytearray(record, "utf-8"))
            stream.close()
            # Where a rename onto a taken name fails, as in HDFS, one of two writers gets the number and the other the next.
            if not system.exists(path) and system.rename(staged, path):
                return number
            system.delete(staged, False)
            if after is not None:
                raise Conflict(f"commit {number} is taken")


def _schema(spark: SparkSession, path: str) -> StructType:
    return StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first()[0]))


def _versioned(spark: SparkSession, path: str, schema: StructType, commits: DataFrame) -> DataFrame:
    """Rows of committed transactions with the number of their commit."""
    if not _exists(spark, path):
        return spark.createDataFrame([], StructType([*schema.fields]).add(_SEQ, LongType()))
    stored = spark.read.schema(StructType([*schema.fields]).add(_TXN, StringType())).parquet(path)
    return stored.join(commits.select(_TXN, F.col("seq").alias(_SEQ)), _TXN).drop(_TXN)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table as of the latest commit."""
    root, table = posixpath.split(path.rstrip("/"))
    schema, commits = _schema(spark, path), _commits(spark, root)
    since = commits.filter(F.array_contains("resets", table)).agg(F.max("seq")).first()[0] or 0
    live = _versioned(spark, path, schema, commits).filter(F.col(_SEQ) >= since)
    if not _exists(spark, f"{path}.retired"):
        return live.drop(_SEQ)
    kinds = StructType([schema["document_id"]]).add("by", StringType()).add("value", StringType())
    retired = _versioned(spark, f"{path}.retired", kinds, commits).groupBy("document_id", "by", "value").agg(F.max(_SEQ).alias("__gone"))
    ways = [r["by"] for r in retired.select("by").distinct().collect()]  # null, and columns of the table
    for by in sorted(ways, key=str):
        own = retired.filter(F.col("by").eqNullSafe(F.lit(by))).select("document_id", "value", "__gone")
        if by is None:
            live = live.join(own.drop("value"), "document_id", "left")
        else:
            live = live.withColumn("value", F.col(by).cast("string")).join(own, ["document_id", "value"], "left").drop("value")
        live = live.filter(F.col("__gone").isNull() | (F.col(_SEQ) >= F.col("__gone"))).drop("__gone")
    return live.select(*schema.names)


def _alone(spark: SparkSession, path: str) -> tuple[Transaction, str]:
    root, table = posixpath.split(path.rstrip("/"))
    return Transaction(spark, root), table


def replace_documents(
    rows: DataFrame, path: str, documents: DataFrame | None = None, *, within: tuple[str, Iterable[str]] | None = None
) -> None:
    """One table's ``Transaction.replace``. ``rows`` may be read from the table itself."""
    change, table = _alone(rows.sparkSession, path)
    change.replace(rows, table, documents, within=within)
    change.commit()


def delete_documents(spark: SparkSession, path: str, documents: DataFrame) -> None:
    change, table = _alone(spark, path)
    change.remove(table, documents)
    change.commit()


def upsert(rows: DataFrame, path: str, key: str) -> None:
    change, table = _alone(rows.sparkSession, path)
    change.upsert(rows, table, key)
    change.commit()


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite a table's rows as one transaction; fails with ``Conflict`` where another commit comes in between."""
    change, table = _alone(spark, path)
    before = _last(spark, change.root)
    rows = settle(read_store(spark, path))
    change._add(rows, table)
    change.commit(resets=[table], after=before)


def append_states(states: DataFrame, path: str) -> None:
    """Question or job states as an append-only log."""
    states.write.mode("append").parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; states of different kinds have different columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


TERMINAL = ("answered", "insufficient_evidence", "failed")


def current_states(log: DataFrame, key: str = "question_id", status: str = "status", at: str = "at") -> DataFrame:
    """Latest state per key. A terminal state is final: what comes after it is ignored."""
    ended = F.col(status).isin(*TERMINAL)
    # The first terminal state when there is one, else the newest state.
    row = F.struct(*[c for c in log.columns if c != key])
    found = log.groupBy(key).agg(
        F.min_by(row, F.when(ended, F.col(at))).alias("__end"), F.max_by(row, F.col(at)).alias("__last")
    )
    return found.select(key, F.coalesce("__end", "__last").alias("s")).select(key, "s.*")


def list_recent(frame: DataFrame, limit: int = 20, by: str = "created_at", tie: str | None = None) -> DataFrame:
    return frame.orderBy(F.desc(by), *([F.desc(tie)] if tie else [])).limit(limit)


def list_recent_per(frame: DataFrame, key: str, limit: int = 20, by: str = "created_at", tie: str | None = None) -> DataFrame:
    order = [F.desc(by)] + ([F.desc(tie)] if tie else [])
    ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def lookup(frame: DataFrame, key: str, value: object) -> DataFrame:
    return frame.filter(F.col(key) == F.lit(value))
