"""When runs that fell silent are launched again: a rule over a table of heartbeats, and the same as a stream.

A run whose last heartbeat is ``stale`` seconds old, and has work left, is launched; while it stays silent it
is launched again every ``cooldown`` seconds, and never twice within that time, also across heartbeats.
Heartbeats are (run, ts, finished); one that says finished ends launches until the next one. Of
heartbeats at the same time, finished wins. Rows without run or time are left out. Times are whole
milliseconds; no launch happens at or after the next heartbeat, or after the end of what is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAUNCHES = "run long, at_ms long, last_ms long, nth int"


def due(last: int, until: int, launched: int | None, stale: int, cooldown: int) -> range:
    """Times of launches in the silence after ``last`` and before ``until``, if the one before was at ``launched``."""
    first = last + stale if launched is None else max(last + stale, launched + cooldown)
    return range(first, until, cooldown)


def launches(heartbeats: DataFrame, until: str, stale_seconds: int = 600, cooldown_seconds: int = 180) -> DataFrame:
    """(run, at_ms, last_ms, nth) up to the time ``until``: nth launch of the silence after last_ms. Heartbeats are
    first merged by run and span of ``stale`` seconds, since none within one is stale; what is exchanged and
    looked at in order grows with the time that a run covers, not with its heartbeats."""
    stale, cooldown = stale_seconds * 1000, cooldown_seconds * 1000
    at = heartbeats.select("run", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("finished", F.lit(False)).alias("finished")).filter("run is not null and at is not null")
    end = F.unix_millis(F.lit(until).cast("timestamp"))
    spans = at.filter(F.col("at") <= end).groupBy("run", F.expr(f"at div {stale}").alias("span")).agg(F.min("at").alias("first"), F.max_by("finished", F.struct("at", "finished")).alias("finished"), F.max("at").alias("last"))
    w = Window.partitionBy("run").orderBy("span")
    silent = spans.select("run", "last", "finished", F.coalesce(F.lead("first").over(w), end + 1).alias("until")).filter(~F.col("finished") & (F.col("until") - F.col("last") > stale))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, launched = [], None
        for last, stop in sorted(zip(group["last"].tolist(), group["until"].tolist())):
            for n, t in enumerate(due(last, stop, launched, stale, cooldown), 1):
                out.append((key[0], t, last, n))
                launched = t
        return pd.DataFrame(out, columns=["run", "at_ms", "last_ms", "nth"])

    return silent.groupBy("run").applyInPandas(run, LAUNCHES)


class Supervisor(StatefulProcessor):
    """Keeps, by run, the heartbeats that the watermark hasn't passed, the last one that it has, and the last launch.
    Timers at the next of either decide once the watermark is there, so late heartbeats still count."""

    def __init__(self, stale_seconds: int, cooldown_seconds: int):
        self.stale, self.cooldown = stale_seconds * 1000, cooldown_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, finished boolean")
        self.heartbeat = handle.getValueState("heartbeat", "at long, finished boolean, n int")
        self.launch = handle.getValueState("launch", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            at = batch["ts"].astype("datetime64[ms]" if batch["ts"].dt.tz is None else "datetime64[ms, UTC]").astype("int64")
            new += [(int(t), bool(f)) for t, f in zip(at, batch["finished"].fillna(False))]
        for at, finished in sorted(set(new)):
            self.waiting.appendValue((at, finished))
        if new:
            self.handle.registerTimer(min(new)[0])
        yield pd.DataFrame(columns=["run", "at_ms", "last_ms", "nth"]).astype({"run": "int64", "at_ms": "int64", "last_ms": "int64", "nth": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((r[0], r[1]) for r in self.waiting.get())
        passed, later = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        last, finished, n = self.heartbeat.get() if self.heartbeat.exists() else (None, True, 0)
        launched = self.launch.get()[0] if self.launch.exists() else None
        out = []
        for at, done in [*passed, (now + 1, None)]:
            if last is not None and not finished:
                for t in due(last, at, launched, self.stale, self.cooldown):
                    n += 1
                    out.append((key[0], t, last, n))
                    launched = t
            if done is not None:
                finished, n = done, n if at == last else 0
                last = at
        if passed:
            self.waiting.put(later) if later else self.waiting.clear()
        if last is not None:
            self.heartbeat.update((last, finished, n))
        if launched is not None:
            self.launch.update((launched,))
        following = [x[0] for x in later[:1]]
        if last is not None and not finished:
            following.append(last + self.stale if launched is None else max(last + self.stale, launched + self.cooldown))
        if following:
            self.handle.registerTimer(min(following))
        yield pd.DataFrame(out, columns=["run", "at_ms", "last_ms", "nth"]).astype({"run": "int64", "at_ms": "int64", "last_ms": "int64", "nth": "int32"})

    def close(self) -> None:
        pass


def launch_stream(heartbeats: DataFrame, stale_seconds: int = 600, cooldown_seconds: int = 180, late: str = "0 seconds") -> DataFrame:
    """``launches`` of a stream of heartbeats, each as soon as the watermark has passed its time: what is out equals the
    table's rows up to there. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = heartbeats.filter("run is not null and ts is not null").select(F.col("run").cast("long").alias("run"), "ts", F.coalesce("finished", F.lit(False)).alias("finished"))
    keyed = rows.withWatermark("ts", late).groupBy("run")
    return keyed.transformWithStateInPandas(Supervisor(stale_seconds, cooldown_seconds), LAUNCHES, "append", "eventTime")
