"""Stateful processors on batches of any shape, against one pass over all events in order."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartulary.plans import load_queries
from cartulary.streaming.jobs import expired_jobs, expiry_processor, state_processor

MINUTE = 60_000_000


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.value, self.timers = _Value(), []

    def getValueState(self, name, schema):  # noqa: N802
        return self.value

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def _frames(rows, size):
    frame = pd.DataFrame(rows, columns=["at", "status"])
    return iter([frame[at : at + size] for at in range(0, len(frame), size)])


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_expiry_does_not_depend_on_frames(size):
    rng = random.Random(size)
    for _ in range(40):
        at, events = 0, []
        for _ in range(rng.randint(1, 60)):
            at += rng.choice([0, 1, 5, 29, 30, 31, 90]) * MINUTE
            events.append((at, rng.choice(["view", "click", "done"])))
        want, current = [], None
        for stamp, status in events:
            if current and stamp - current[1] > 30 * MINUTE:
                want.append(current)
            current = None if status == "done" else (status, stamp)
        handle, found = _Handle(), []
        processor = expiry_processor(1800, ("done",))
        processor.init(handle)
        cut = sorted(rng.sample(range(len(events) + 1), 2)) if len(events) > 2 else [0, 0]
        for batch in (events[: cut[0]], events[cut[0] : cut[1]], events[cut[1] :]):
            shuffled = batch if len({a for a, _ in batch}) < len(batch) else rng.sample(batch, len(batch))
            for out in processor.handleInputRows(("job",), _frames(shuffled, size), None) if batch else ():
                found += [(r.last_status, int(r.last_ts.value // 1000)) for r in out.itertuples()]
        assert found == want
        assert handle.value.held == current and len(handle.timers) == (current is not None)
        if current:
            (last,) = processor.handleExpiredTimer(("job",), None, None)
            assert last["last_status"].tolist() == [current[0]] and handle.value.held is None


def test_a_long_batch_is_kept_as_stretches():
    at = pd.Series(range(300_000)) * 1_000_000
    frames = (pd.DataFrame({"at": at[n : n + 50_000], "status": "view"}) for n in range(0, len(at), 50_000))
    handle = _Handle()
    processor = expiry_processor(1800, ("done",))
    processor.init(handle)
    assert list(processor.handleInputRows(("job",), frames, None)) == [] and handle.value.held == ("view", 299_999_000_000)


def test_first_end_stands():
    handle = _Handle()
    processor = state_processor(("answered", "failed"), 600)
    processor.init(handle)
    run = lambda *rows: [(r.status, r.ts.value // 1000) for out in processor.handleInputRows(("q",), _frames(list(rows), 1), None) for r in out.itertuples()]
    assert run((5, "queued")) == [("queued", 5)]
    assert run((9, "running"), (7, "queued")) == [("running", 9)]
    assert run((30, "failed"), (20, "answered"), (40, "running")) == [("answered", 20)]
    assert run((50, "failed")) == [] and handle.value.held == ("answered", 20)
    assert list(processor.handleExpiredTimer(("q",), None, None)) == [] and handle.value.held is None


def test_stream_index_reads_files_and_folders(spark, tmp_path):
    rows = [(1, 0, "user", "first words"), (1, 1, "assistant", "second words"), (2, 0, "user", "third words")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = [("1", 0, "first words"), ("1", 1, "second words"), ("2", 0, "third words")]
    table.repartition(3).write.parquet(f"{tmp_path}/parts/conversations.parquet")
    found = load_queries()["stream_index"].run(spark, f"{tmp_path}/parts")
    assert sorted((r["document_id"], r["chunk_index"], r["text"]) for r in found.collect()) == want
    assert load_queries()["stream_index"].run(spark, "/root/testdata/sf0.001").count() > 0


def test_expiry_is_a_session_of_events_in_spark(spark, tmp_path):
    """No Python state per job, and silences of the timeout and one microsecond more are told apart."""
    micros = [("a", "view", 0), ("a", "click", 30 * MINUTE), ("a", "view", 60 * MINUTE + 1), ("a", "error", 61 * MINUTE)]
    micros += [("b", "view", 5 * MINUTE), ("end", "view", 600 * MINUTE)]
    rows = spark.createDataFrame(micros, "job_id string, status string, at long")
    rows.select("job_id", "status", F.timestamp_micros("at").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("job_id string, status string, ts timestamp").parquet(f"{tmp_path}/events")
    expired = expired_jobs(stream, ("error",))
    assert "transformwithstate" not in expired._jdf.queryExecution().logical().toString().lower()
    query = expired.writeStream.format("memory").queryName("expired_sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    found = [(r["job_id"], r["last_status"], r["last_ts"], r["expired_at"]) for r in spark.table("expired_sessions").orderBy("job_id").collect()]
    epoch = pd.Timestamp(0)
    assert found == [
        ("a", "click", epoch + pd.Timedelta(minutes=30), epoch + pd.Timedelta(minutes=60)),
        ("b", "view", epoch + pd.Timedelta(minutes=5), epoch + pd.Timedelta(minutes=35)),
    ]
