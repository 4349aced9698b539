"""Heartbeats as a stream: sessions by event time, and the batch status of each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Event files as they arrive. Watermarks need a timestamp of the session's zone."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return raw.select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), F.col("value").alias("tokens"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of each run: closed once the watermark has passed their end by the gap."""
    out = events.withWatermark("ts", late).groupBy("run", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return out.select("run", F.col("session_window.start").alias("first_ts"), "last_ts", "n")


def windows(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Requests and tokens of each run in sliding windows."""
    out = events.withWatermark("ts", late).groupBy("run", F.window("ts", length, slide)).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return out.select("run", F.col("window.start").alias("start"), "requests", "tokens")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs the stream over what is there and stops."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(events: DataFrame, checkpoint: str, handle) -> StreamingQuery:
    """``handle(batch, number)`` for each micro-batch: the same transforms as over tables."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staleness(events: DataFrame, stale_seconds: int = 600, late: str = "0 seconds") -> DataFrame:
    """(run, last_ts, status) whenever a run's status changes: running while its heartbeats come, stale
    once event time has passed its last one by ``stale_seconds``, running again with the next. Kept per
    run is its last heartbeat alone; a timer of the watermark tells that none came."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            last, _ = state.get
            out.append((key[0], pd.Timestamp(last, unit="ms"), "stale"))
            state.update((last, True))
        else:
            last, stale = state.get if state.exists else (None, True)
            for now in sorted(int(t.timestamp() * 1000) for b in batches for t in b["ts"]):
                if last is not None and not stale and now - last > stale_seconds * 1000:  # before its timer came
                    out.append((key[0], pd.Timestamp(last, unit="ms"), "stale"))
                    stale = True
                last = now if last is None else max(last, now)
                if stale:
                    out.append((key[0], pd.Timestamp(now, unit="ms"), "running"))
                    stale = False
            state.update((last, False))
            state.setTimeoutTimestamp(max(last + stale_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run", "last_ts", "status"]).astype({"run": "int64", "last_ts": "datetime64[ns]", "status": "object"})

    keyed = events.withWatermark("ts", late).groupBy("run")
    return keyed.applyInPandasWithState(update, "run long, last_ts timestamp, status string", "last_ms long, stale boolean", "append", GroupStateTimeout.EventTimeTimeout)
