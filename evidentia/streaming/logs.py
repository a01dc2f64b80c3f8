"""Structured Streaming over the append-only logs; what streams give in the end equals their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_log(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 64) -> DataFrame:
    """A growing folder of Parquet files as a stream, so many files at a time. Event time becomes a
    timestamp, as watermarks need one."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(log: DataFrame, key: str = "event_id", late: str = "7 days") -> DataFrame:
    """Deliveries of the same key within the watermark count once."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(log: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Tumbling or sliding counts by type, closed when the watermark has passed."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(log: DataFrame, gap: str = "6 hours", late: str = "7 days") -> DataFrame:
    return log.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


_STATE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])


def latest_states(log: DataFrame, keep: str | None = None) -> DataFrame:
    """The last event of each user so far, emitted whenever it changes; events may arrive in any order.

    With ``keep`` (an interval, as ``30 days``) the state of a user who was silent for so long, by the
    watermark, is dropped; a later event begins anew. Without it states are kept for ever, which only
    suits a bounded set of users.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        before = last
        for frame in frames:
            row = frame.sort_values(["ts", "event_id"]).iloc[-1]
            seen = (row.ts.to_pydatetime(), int(row.event_id), row.event_type)
            if last is None or seen[:2] > tuple(last[:2]):
                last = seen
        if keep is not None:
            until = int(pd.Timestamp(last[0]).timestamp() * 1000) + int(pd.Timedelta(keep).total_seconds() * 1000)
            if until > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(until)
        if last != before:
            state.update(last)
            yield pd.DataFrame({"user_id": [key[0]], "last_type": [last[2]], "last_event": [last[1]]})

    marked = log if keep is None else log.withWatermark("ts", "1 hour")
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    return marked.groupBy("user_id").applyInPandasWithState(fold, "user_id bigint, last_type string, last_event bigint", _STATE, "update", timeout)


_LEASE = T.StructType([T.StructField("attempts", T.IntegerType()), T.StructField("until", T.LongType()), T.StructField("status", T.StringType())])


def leases(log: DataFrame, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """``job_id, status, attempts, at`` whenever the state of a job changes, from a log of ``job_id, ts,
    event`` (``claim``, ``heartbeat``, ``done``).

    A claim begins an attempt and a lease of so many seconds, a heartbeat renews the lease, ``done`` ends
    the job. When the watermark passes the end of a lease the job is ``pending`` again, or ``failed``
    (a dead letter) after ``most`` attempts. Events of finished jobs and repeated deliveries change
    nothing; a heartbeat without a lease neither.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, until, status = state.get if state.exists else (0, 0, "pending")
        out = []

        def expire(now: int) -> None:
            nonlocal status
            if status == "running" and now >= until:
                status = "failed" if attempts >= most else "pending"
                out.append((key[0], status, attempts, pd.Timestamp(until, unit="ms")))

        if state.hasTimedOut:
            expire(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(frames)).drop_duplicates(["ts", "event"]).sort_values(["ts", "event"])
            for ts, event in zip(rows.ts, rows.event, strict=True):
                now = int(ts.timestamp() * 1000)
                expire(now)
                if status in ("done", "failed"):
                    continue
                if event == "claim" and status == "pending":
                    attempts, until, status = attempts + 1, now + 1000 * seconds, "running"
                    out.append((key[0], status, attempts, ts))
                elif event == "heartbeat" and status == "running":
                    until = max(until, now + 1000 * seconds)
                elif event == "done" and status == "running":
                    status = "done"
                    out.append((key[0], status, attempts, ts))
        state.update((attempts, until, status))
        if status == "running":
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "status", "attempts", "at"])

    marked = log.select("job_id", "ts", "event").withWatermark("ts", late)
    return marked.groupBy("job_id").applyInPandasWithState(fold, "job_id string, status string, attempts int, at timestamp", _LEASE, "append", GroupStateTimeout.EventTimeTimeout)


def lease_states(log: DataFrame, seconds: int, most: int, as_of: str) -> DataFrame:
    """``job_id, status, attempts``: the batch twin of :func:`leases` at a given time, by a fold over the
    events of each job in order, inside generated code. A job's events are few."""
    events = F.array_sort(F.collect_set(F.struct(F.unix_millis("ts").alias("t"), "event")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("until"), F.lit("pending").alias("s"))

    def expired(acc, now):
        gone = (acc["s"] == "running") & (now >= acc["until"])
        return F.when(gone, F.when(acc["n"] >= most, "failed").otherwise("pending")).otherwise(acc["s"])

    def step(acc, x):
        s, end = expired(acc, x["t"]), x["t"] + 1000 * seconds
        claim, beat, done = (x["event"] == "claim") & (s == "pending"), (x["event"] == "heartbeat") & (s == "running"), (x["event"] == "done") & (s == "running")
        return F.struct(
            F.when(claim, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(claim, end).when(beat, F.greatest(acc["until"], end)).otherwise(acc["until"]).alias("until"),
            F.when(claim, "running").when(done, "done").otherwise(s).alias("s"),
        )

    folded = log.groupBy("job_id").agg(F.aggregate(events, start, step).alias("a"))
    now = F.unix_millis(F.lit(as_of).cast("timestamp"))
    return folded.select("job_id", expired(F.col("a"), now).alias("status"), F.col("a.n").alias("attempts"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write everything that is there and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
