"""Structured Streaming: index on arrival, expire silent jobs, follow the current status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from cartulary.config import DEFAULTS, Settings
from cartulary.plans.jobs import Store, index_documents
from cartulary.session import settle
from cartulary.sources.store import read_store, upsert

OUTCOME_SCHEMA = "job_id string, last_status string, last_ts timestamp_ntz, expired_at timestamp_ntz"


def index_stream(
    sections: DataFrame, store: Store, checkpoint: str, settings: Settings = DEFAULTS, *, family: str = "blake2b",
    newest_by: str | None = None,
) -> StreamingQuery:
    """Index the documents of every micro-batch.

    Sections are stored by document and index first; every touched document is then indexed from all its stored
    sections, so a document may arrive over several batches, and a batch that is delivered twice changes nothing but
    its own entry of the log, which is overwritten.
    """

    def index(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = F.concat_ws("/", F.col("document_id").cast("string"), F.col("section_index").cast("string"))
        keyed = batch.withColumn("section_key", key)
        # Of two versions in one batch the newest stays; without a column that tells, the one whose text sorts last.
        newest = [F.desc(newest_by)] if newest_by else []
        nth = F.row_number().over(Window.partitionBy("section_key").orderBy(*newest, F.desc("title"), F.desc("text")))
        arrived = settle(keyed.withColumn("__nth", nth).filter("__nth = 1").drop("__nth"))
        upsert(arrived, store.path("sections"), "section_key")
        documents = arrived.select("document_id").distinct()
        whole = read_store(spark, store.path("sections")).join(documents, "document_id", "left_semi").drop("section_key")
        logged = index_documents(documents, whole, store, settings, family=family)
        logged.write.mode("overwrite").parquet(f"{store.path('index_log')}/batch={number}")

    return (
        sections.writeStream.foreachBatch(index)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Outlines(dict):
    """First time, last time and last status of each stretch of ``limit`` microseconds in which events came.

    Two events of a stretch are never ``limit`` apart, so only its rim can border on a silence. A job's batch is kept as
    these stretches, however many events it has, and each frame of it is reduced by columns.
    """

    def __init__(self, limit: int, since: int | None) -> None:
        super().__init__()
        self.limit, self.since = limit, since

    def take(self, frame: pd.DataFrame) -> None:
        own = frame if self.since is None else frame[frame["at"] >= self.since]
        own = own.sort_values("at", kind="stable")
        grouped = own.groupby(own["at"] // self.limit).agg(first=("at", "first"), last=("at", "last"), status=("status", "last"))
        for stretch, first, last, status in grouped.itertuples():
            known = self.get(stretch)
            if known is None:
                self[stretch] = (first, last, status)
            else:
                newer = (last, status) if last >= known[1] else known[1:]
                self[stretch] = (min(first, known[0]), *newer)


def expiry_processor(timeout_seconds: int, terminal: tuple[str, ...]) -> StatefulProcessor:
    """The rule of ``expired_jobs`` for streams that keep further state of a job beside it.

    State per job: its newest event. A terminal event forgets the job; silence beyond the timeout expires it.

    Silence shows either as a gap before the next event or, when nothing follows, through the timer, so the
    outcome does not depend on how events are cut into batches or frames.
    """
    limit = timeout_seconds * 1_000_000

    def rows(job: str, found: list[tuple[str, int]]) -> pd.DataFrame:
        stamps = pd.to_datetime(pd.Series([at for _, at in found], dtype="int64"), unit="us")
        return pd.DataFrame(
            {"job_id": job, "last_status": [s for s, _ in found], "last_ts": stamps, "expired_at": stamps + pd.Timedelta(seconds=timeout_seconds)}
        )

    class Expire(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # The event time is kept in microseconds, which no time zone can shift.
            self.last = handle.getValueState("last", "status string, at bigint")

        def handleInputRows(self, key, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            current = tuple(self.last.get()) if self.last.exists() else None
            outlines = _Outlines(limit, current[1] if current else None)
            for frame in frames:
                outlines.take(frame)
            expired = []
            for stretch in sorted(outlines):
                first, last, status = outlines[stretch]
                if current is not None and first - current[1] > limit:
                    expired.append(current)
                current = None if status in terminal else (status, int(last))
            if expired:
                yield rows(key[0], expired)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if current is None:
                self.last.clear()
            else:
                self.last.update(current)
                self.handle.registerTimer(current[1] // 1000 + timeout_seconds * 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if self.last.exists():
                current = tuple(self.last.get())
                self.last.clear()
                yield rows(key[0], [current])

        def close(self) -> None:
            pass

    return Expire()


def state_processor(terminal: tuple[str, ...], kept_seconds: int) -> StatefulProcessor:
    """State per job: its current status. The first terminal status stands, and what comes later is ignored.

    The state goes ``kept_seconds`` after the job's last event in event time: a job that ended is held that long to
    turn late events away, one that never ends does not stay for ever.
    """

    class Latch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "status string, at bigint")

        def handleInputRows(self, key, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held = tuple(self.state.get()) if self.state.exists() else None
            current = held
            for frame in frames:
                if held is not None and held[0] in terminal:
                    return
                ended = frame[frame["status"].isin(terminal)]
                if len(ended):  # the first end of the batch
                    row = ended.loc[ended["at"].idxmin()]
                    if current is None or current[0] not in terminal or row["at"] < current[1]:
                        current = (row["status"], int(row["at"]))
                elif current is None or current[0] not in terminal:
                    newest = frame[frame["at"] == frame["at"].max()].iloc[-1]
                    if current is None or newest["at"] >= current[1]:
                        current = (newest["status"], int(newest["at"]))
            if current == held:
                return
            self.state.update(current)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(current[1] // 1000 + kept_seconds * 1000)
            yield pd.DataFrame({"job_id": [key[0]], "status": [current[0]], "ts": pd.to_datetime([current[1]], unit="us")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self.state.clear()
            yield from ()

        def close(self) -> None:
            pass

    return Latch()


def job_states(
    events: DataFrame, terminal: tuple[str, ...], settings: Settings = DEFAULTS, *, lateness: str = "5 minutes", kept_seconds: int | None = None
) -> DataFrame:
    """Changes of each job's status: (job_id, status, ts). The newest row of a job is its state.

    ``events``: job_id string, status string, ts timestamp. Needs the RocksDB state store.
    """
    timed = events.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=state_processor(terminal, settings.stale_job_timeout_seconds if kept_seconds is None else kept_seconds),
        outputStructType="job_id string, status string, ts timestamp_ntz",
        outputMode="update",
        timeMode="EventTime",
    )


def _sessions(events: DataFrame, seconds: int) -> DataFrame:
    """Each job's events up to a silence, with the last of them; a silence of just ``seconds`` ends no session."""
    # Sessions that touch are merged.
    return events.groupBy("job_id", F.session_window("ts", f"{seconds} seconds")).agg(
        F.max_by("status", "ts").alias("last_status"), F.max("ts").alias("last_ts")
    )


def moment(micros: Column) -> Column:
    """Microseconds since 1970 as a timestamp without a time zone."""
    since = F.make_dt_interval(secs=micros.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def _outcomes(sessions: DataFrame, terminal: tuple[str, ...], seconds: int) -> DataFrame:
    # Without a time zone, as its microseconds are counted.
    stamp = moment(F.unix_micros("last_ts"))
    return sessions.filter(~F.coalesce(F.col("last_status").isin(*terminal), F.lit(False))).select(
        "job_id", "last_status", stamp.alias("last_ts"), (stamp + F.make_dt_interval(secs=F.lit(seconds))).alias("expired_at")
    )


def expired_jobs(
    events: DataFrame, terminal: tuple[str, ...], settings: Settings = DEFAULTS, *, lateness: str = "5 minutes"
) -> DataFrame:
    """Jobs whose last event is older than the timeout in event time.

    ``events``: job_id string, status string, ts timestamp. A job's events up to a silence are a session, whose last
    event tells whether the job had ended. State is one row per open session, ended by the watermark; a session that
    the watermark has not passed where the stream ends is left to ``last_silences``.
    """
    seconds = settings.stale_job_timeout_seconds
    return _outcomes(_sessions(events.withWatermark("ts", lateness), seconds), terminal, seconds)


def last_silences(
    events: DataFrame, terminal: tuple[str, ...], after: int, until: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """Outcomes of a stream that ended, of the sessions whose timeout fell after ``after``.

    ``events``: all that arrived; ``after`` and ``until`` are microseconds of event time. Such a session expired if a
    later event of its job shows the silence, or, where nothing follows, if its timeout fell at ``until`` or before.
    Only the events that can belong to such sessions are read.
    """
    seconds = settings.stale_job_timeout_seconds
    limit = seconds * 1_000_000
    sessions = _sessions(events.filter(F.col("ts") > F.timestamp_micros(F.lit(after - limit))), seconds)
    following = F.lead("last_ts").over(Window.partitionBy("job_id").orderBy("last_ts"))
    shown = sessions.withColumn("__next", following).filter(
        F.col("__next").isNotNull() | (F.unix_micros("last_ts") + F.lit(limit) <= F.lit(until))
    )
    return _outcomes(shown, terminal, seconds)


def current_status(events: DataFrame) -> DataFrame:
    """Running latest status per job; use the update output mode. Its state has no end: ``job_states`` is for open streams."""
    return events.groupBy("job_id").agg(
        F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts")
    )
