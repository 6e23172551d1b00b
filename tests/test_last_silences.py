"""Where a stream ends: silences shown by a later event before the watermark, microseconds of the mark, and no status."""

import datetime as dt
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from cartulary.plans import load_queries
from tests.oracle import TABLES, compare, connect, spark_bag, sql_bag

FOLDER = Path("/root/testdata/sf0.001")
END = dt.datetime(2024, 3, 1, 12, 0, 0, 500_900)


def test_the_end_of_the_stream_follows_the_sql(spark, tmp_path):
    for table in TABLES:
        if table != "events":
            (tmp_path / f"{table}.parquet").symlink_to(FOLDER / f"{table}.parquet")
    minutes = lambda n, micros=0: END - dt.timedelta(minutes=n, microseconds=-micros)
    found = [
        (900_000, minutes(33), "view"), (900_000, minutes(2), "click"),  # a later event shows the silence
        (900_001, minutes(34), "error"), (900_001, minutes(1), "click"),
        (900_002, minutes(33), "click"), (900_002, minutes(3), "view"),  # just the timeout
        (900_003, minutes(35, -200), "view"),  # at the mark's millisecond, before its microsecond
        (900_004, minutes(35), "view"),
        (900_005, minutes(35, 1), "view"),
        (900_006, minutes(34), "view"), (900_006, minutes(3, 1), "purchase"),
        (900_007, minutes(33), None), (900_007, minutes(2), "click"),
        (900_008, minutes(500), None),
        (900_009, END, "view"),
    ]
    given = pq.read_table(FOLDER / "events.parquet")
    more = [{"event_id": 900_000 + i, "user_id": u, "ts": ts, "event_type": s} for i, (u, ts, s) in enumerate(found)]
    pq.write_table(pa.concat_tables([given, pa.Table.from_pylist(more, schema=given.schema)]), tmp_path / "events.parquet")
    item = load_queries()["stream_expired"]
    expected = sql_bag(connect(str(tmp_path)), item.sql)
    jobs = {row[expected[0].index("job_id")] for row in expected[1]} & {str(900_000 + i) for i in range(10)}
    assert jobs == {"900000", "900003", "900004", "900006"}
    assert compare(spark_bag(item.run(spark, str(tmp_path))), expected) is None
