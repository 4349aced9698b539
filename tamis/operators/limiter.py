"""Admission of requests under limits of requests and tokens in a sliding window.

The requests of a key are admitted one after another, in order of arrival: each as soon as the window
before it holds fewer requests than allowed and its tokens still fit (a request that alone is too
large waits for an empty window). A key's requests are cut into spans of time, which are worked on
apart from each other, so that a key of very many requests is many tasks. What one span leaves for the
next is no more than the requests that fit a window. Spans first begin with an empty window; those
whose predecessor turns out to reach into them are done again, until none changes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators import shared

SECOND = 1_000_000


class Line:
    """Admits requests in order: arrival and admission in microseconds."""

    def __init__(self, window: int, requests: int, most: int):
        self.window, self.requests, self.most = window, requests, most
        self.held: deque[tuple[int, int]] = deque()
        self.total = self.now = 0

    def put(self, at: int, tokens: int) -> None:
        self.held.append((at, tokens))
        self.total, self.now = self.total + tokens, at

    def _out(self) -> int:
        left, n = self.held.popleft()
        self.total -= n
        return left + self.window

    def take(self, arrival: int, tokens: int) -> int:
        now = max(self.now, arrival)
        while self.held and (self.held[0][0] + self.window <= now or len(self.held) >= self.requests or self.total + tokens > self.most):
            now = max(now, self._out())
        self.put(now, tokens)
        return now

    def left_over(self) -> list[dict]:
        while self.held and self.held[0][0] + self.window <= self.now:
            self._out()
        return [{"at": a, "tokens": n} for a, n in self.held]


def _lines(batches: Iterable[pa.RecordBatch], limits: tuple, left: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (key, span, kind, at, id, tokens) in this order, of which kind 0 is carried over and 1 arrives:
    what each span leaves over, or when each request is admitted."""
    of, line = None, None
    for batch in batches:
        out = []
        for key, span, kind, at, ident, n in zip(*(c.to_pylist() for c in batch.columns)):
            if of != (key, span):
                if left and of:
                    out.append({"key": of[0], "span": of[1], "after": line.left_over()})
                of, line = (key, span), Line(*limits)
            if not kind:
                line.put(at, n)
                continue
            now = line.take(at, n)
            if not left:
                out.append({"key": key, "id": ident, "at": at, "admitted": now})
        yield pa.RecordBatch.from_pylist(out, schema)
    if left and of:
        yield pa.RecordBatch.from_pylist([{"key": of[0], "span": of[1], "after": line.left_over()}], schema)


def admission(events: DataFrame, window_seconds: int = 60, requests: int = 60, tokens: int = 100_000, margin: float = 0.8, span_seconds: int = 3600) -> DataFrame:
    """(key, id, admitted_at, wait_seconds) of events (key, id, ts, tokens: a whole number): ``margin`` of
    ``requests`` and of ``tokens`` are allowed in the window. Ties of ts are in the order of id; a null ts
    or tokens counts as an arrival at the beginning and as none; no rows give no rows."""
    window, most_requests, most_tokens = window_seconds * SECOND, max(1, int(requests * margin)), int(tokens * margin)
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))
    rows = events.select("key", "id", at.alias("at"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    rows = shared.stored(rows.withColumn("span", F.floor(F.col("at") / (span_seconds * SECOND)).cast("long")), "requests")
    key, ident = (rows.schema[c].dataType.simpleString() for c in ("key", "id"))
    spans = rows.groupBy("key", "span").agg(F.min("at").alias("first"))
    carried = "array<struct<at:bigint,tokens:bigint>>"
    empty = F.array().cast(carried)
    limits = window, most_requests, most_tokens

    def lines(arrived: DataFrame, begin: DataFrame, left: bool, kinds: str) -> DataFrame:
        carry = begin.select("key", "span", F.lit(0).alias("kind"), F.explode("before").alias("c")).select("key", "span", "kind", "c.at", F.lit(None).cast(ident).alias("id"), "c.tokens")
        every = arrived.select("key", "span", F.lit(1).alias("kind"), "at", "id", "tokens").unionByName(carry)
        schema = pa.schema(rows.sparkSession.createDataFrame([], kinds).toArrow().schema)
        return every.repartition("key", "span").sortWithinPartitions("key", "span", "kind", "at", "id").mapInArrow(lambda batches: _lines(batches, limits, left, schema), kinds)

    state = shared.stored(spans.select("key", "span", "first", empty.alias("before"), F.lit(None).cast(carried).alias("after")), "spans")
    todo = state.select("key", "span", "before")
    order = Window.partitionBy("key").orderBy("span")
    while True:
        some = todo.select(F.col("key").alias("k"), F.col("span").alias("s"))
        new = lines(rows.join(some, F.col("key").eqNullSafe(F.col("k")) & (F.col("span") == F.col("s")), "left_semi"), todo, True, f"key {key}, span long, after {carried}")
        new = new.select(F.col("key").alias("k"), F.col("span").alias("s"), F.col("after").alias("new"))
        state = state.join(new, F.col("key").eqNullSafe(F.col("k")) & (F.col("span") == F.col("s")), "left").select("key", "span", "first", "before", F.coalesce("new", "after").alias("after"))
        # What is left over reaches into the next span if its last request is in the window of the first there.
        last = F.lag("after").over(order)
        reaches = F.array_max(F.transform(last, lambda x: x["at"])) + window > F.col("first")
        state = shared.stored(state.withColumn("begin", F.when(reaches, last).otherwise(empty)), "spans")
        todo = state.filter(~F.col("begin").eqNullSafe(F.col("before"))).select("key", "span", F.col("begin").alias("before"))
        state = state.select("key", "span", "first", F.col("begin").alias("before"), "after")
        if todo.isEmpty():
            break
    done = lines(rows, state, False, f"key {key}, id {ident}, at long, admitted long")
    return done.select("key", "id", F.timestamp_micros("admitted").alias("admitted_at"), ((F.col("admitted") - F.col("at")) / SECOND).alias("wait_seconds"))
