"""Run registered queries next to their SQL in DuckDB and compare rows.

``python -m tests.oracle [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    if isinstance(value, dict):
        return tuple(sorted((key, _plain(item)) for key, item in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((key, _plain(item)) for key, item in value.asDict().items()))
    return value


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_bag(frame) -> tuple[list[str], Counter]:
    return bag(frame.columns, frame.collect())


def sql_bag(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    return bag([item[0] for item in cursor.description], cursor.fetchall())


def compare(left, right) -> str | None:
    """None when equal, else a short description of the difference."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        extra, missing = left[1] - right[1], right[1] - left[1]
        return (
            f"rows {sum(left[1].values())} vs {sum(right[1].values())}; "
            f"only spark {sum(extra.values())} e.g. {list(extra)[:2]}; "
            f"only sql {sum(missing.values())} e.g. {list(missing)[:2]}"
        )
    return None


def main() -> None:
    from cartulary.plans import load_queries
    from cartulary.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name, item in load_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            started = time.time()
            result = spark_bag(item.run(spark, folder))
            seconds = time.time() - started
            rows = sum(result[1].values())
            if item.sql:
                started = time.time()
                problem = compare(result, sql_bag(connection, item.sql))
                sql_seconds = time.time() - started
                print(f"{'OK  ' if problem is None else 'DIFF'} {name} rows={rows} {seconds:.2f}s sql {sql_seconds:.2f}s {(problem or '')[:1500]}", flush=True)
            else:
                print(f"ROWS {name} rows={rows} {seconds:.2f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
