"""Sharding by histogram sort: probe, count, refine, then exchange once.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours: a group of copies
is in one shard, or in as many consecutive ones as its bytes fill. The bytes below each probe are
counted exactly, across all partitions; the probes around each wanted splitter are then spread
over the one gap that it lies in, until a probe is within TOLERANCE of its place. Where the gap is
a single hash (a text with a large share of the rows), probes go on over its doc_ids. Only counts
reach the driver: at most MOST_COUNTS a round, or 4 for each open splitter.

Each shard is cut into ranges of nearly equal bytes, as many as its bytes need, so that the exchange
and the sort of a shard are shared by several tasks; a row's slot is its rank in the range after
the rows of the shard's ranges before it.

Handling of odd rows: a null text has size 8 and the crc32 of no bytes, and is sorted like an empty
one; a null doc_id comes first; rows equal in text and doc_id can't be parted by a splitter; no
rows give no rows; where all rows are one key, all are in one shard. Documents are carried as one
struct ``row``, so that any names may be among their columns.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS, RANGES, PROBES, FIRST_PROBES, TOLERANCE = 24, 8, 256, 4096, 0.0005
#: Bytes that one task sorts, about: shards have as many ranges as that needs, RANGES at least.
RANGE_BYTES = 1 << 30
#: Counts of one round at most; where more splitters are open each has fewer probes, but 4 at least.
MOST_COUNTS = 1 << 20
_TOP = (1 << 63) - 1
#: Bits of k below those that number the first probes.
_SHIFT = 51


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, size, text_crc32, k, d): k and d are the order, as numbers of 63 bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc = F.col("doc_id").cast("long")
    d = F.coalesce(F.shiftrightunsigned(doc.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 1), F.lit(0))
    return docs.select(doc.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("k"), d.alias("d"), *more)


def with_range(rows: DataFrame, starts: list[tuple[int, int]]) -> DataFrame:
    """rows with range: how many of the ascending ``starts`` (k, d) are at or below the row's key.

    A table of FIRST_PROBES rows, whatever the data, gives for the leading bits of k the starts
    below them and the list of those among them, which is short but for a text of many copies."""
    table, below = [], 0
    for lead in range(FIRST_PROBES):
        end = bisect.bisect_left(starts, ((lead + 1) << _SHIFT, -1), lo=below)
        table.append((lead, below, [tuple(x) for x in starts[below:end]]))
        below = end
    known = F.broadcast(rows.sparkSession.createDataFrame(table, "_lead long, _below int, _starts array<struct<k: long, d: long>>"))
    inside = F.filter("_starts", lambda s: (s["k"] < F.col("k")) | ((s["k"] == F.col("k")) & (s["d"] <= F.col("d"))))
    out = rows.join(known, F.shiftright("k", _SHIFT) == F.col("_lead"))
    return out.withColumn("range", F.col("_below") + F.size(inside)).drop("_lead", "_below", "_starts")


class _Gap:
    """The keys low..high (both included) of k, or of d under one k, with the bytes below them."""

    def __init__(self, low: int, high: int, below: int, hot: int | None = None):
        self.low, self.high, self.below, self.hot, self.targets = low, high, below, hot, []

    def step(self, probes: int) -> int:
        return max(1, -(-(self.high - self.low + 1) // probes))


def _count(rows: DataFrame, gaps: list[_Gap], probes: int) -> dict[int, list[tuple[int, int]]]:
    """For each gap the bytes by piece between probes, in order."""
    spark = rows.sparkSession
    found: dict[int, list[tuple[int, int]]] = {}
    plain = [(i, g.low >> _SHIFT, g.low, g.high, g.step(probes)) for i, g in enumerate(gaps) if g.hot is None]
    hot = [(i, g.hot, g.low, g.high, g.step(probes)) for i, g in enumerate(gaps) if g.hot is not None]
    parts = []
    if len(plain) == 1 and plain[0][2] == 0 and plain[0][3] == _TOP:
        parts.append(rows.select(F.lit(plain[0][0]).alias("gap"), F.expr(f"k div {plain[0][4]}").alias("piece"), "size"))
    elif plain:  # a gap lies between two of the first probes, so its leading bits find it
        table = spark.createDataFrame(plain, "gap int, lead long, low long, high long, step long")
        found_in = (F.shiftright("k", _SHIFT) == F.col("lead")) & F.col("k").between(F.col("low"), F.col("high"))
        parts.append(rows.join(F.broadcast(table), found_in).select("gap", F.expr("(k - low) div step").alias("piece"), "size"))
    if hot:
        table = spark.createDataFrame(hot, "gap int, hot long, low long, high long, step long")
        parts.append(rows.join(F.broadcast(table), (F.col("k") == F.col("hot")) & F.col("d").between(F.col("low"), F.col("high"))).select("gap", F.expr("(d - low) div step").alias("piece"), "size"))
    for part in parts:
        for r in part.groupBy("gap", "piece").agg(F.sum("size").alias("bytes")).collect():
            found.setdefault(r.gap, []).append((r.piece, r.bytes))
    return {i: sorted(x) for i, x in found.items()}


def splitters(rows: DataFrame, shards: int, ranges: int, tolerance: float) -> tuple[int, list[tuple[int, int]], int]:
    """Bytes in all, the keys (k, d) at which each range but the first begins, and the rounds used.
    tolerance: how far the first range of a shard may be from its place, as a share of a shard's
    bytes; ranges within a shard only share out work and may be off by a tenth of a range."""
    parts = shards * ranges
    total, least, most = rows.agg(F.sum("size"), F.min("d"), F.max("d")).first()
    total = total or 0
    out: dict[int, tuple[int, int]] = {}
    if not total:
        return 0, [], 0
    allowed = {True: tolerance * total / shards, False: 0.1 * total / parts}
    first = _Gap(0, _TOP, 0)
    first.targets = list(range(1, parts))
    gaps, rounds = [first] if parts > 1 else [], 0
    while gaps:
        probes = max(4, min(PROBES, MOST_COUNTS // len(gaps))) if rounds else FIRST_PROBES
        found = _count(rows, gaps, probes)
        rounds += 1
        later: dict[tuple, _Gap] = {}
        for i, gap in enumerate(gaps):
            step, pieces = gap.step(probes), found.get(i, [])
            upto, sums = gap.below, []
            for _, n in pieces:
                upto += n
                sums.append(upto)
            for t in gap.targets:
                want = total * t / parts
                j = min(bisect.bisect_left(sums, want), len(pieces) - 1)
                piece, n = pieces[j]
                low, high = gap.low + piece * step, min(gap.high, gap.low + (piece + 1) * step - 1)
                before, after = sums[j] - n, sums[j]
                where = (lambda x, g=gap: (x, 0) if g.hot is None else (g.hot, x))
                if step > 1 or gap.hot is None:
                    if min(want - before, after - want) > allowed[t % ranges == 0]:
                        key = (low, high, gap.hot) if step > 1 else (least, most, low)
                        later.setdefault(key, _Gap(key[0], key[1], before, key[2])).targets.append(t)
                        continue
                out[t] = where(low) if want - before <= after - want else where(high + 1)
        gaps = list(later.values())
    return total, sorted(out[t] for t in range(1, parts)), rounds


def shards_of(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None, tolerance: float = TOLERANCE, keep: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) and, with ``keep``, all columns as ``row`` of each row of
    ``docs``, by one exchange. ranges: of each shard; by default as many as its bytes need."""
    spark = docs.sparkSession
    rows = common.materialise(keyed(docs), "keys")
    if ranges is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        ranges = max(RANGES, -(-total // (shards * RANGE_BYTES)))
    _, starts, _ = splitters(rows, shards, ranges, tolerance)
    whole = keyed(docs, common.whole(docs).alias("row")) if keep else rows
    counts = {r.range: r.n for r in with_range(rows, starts).groupBy("range").agg(F.count("*").alias("n")).collect()}
    before = []
    for i in range(shards * ranges):
        before.append(0 if i % ranges == 0 else before[-1] + counts.get(i - 1, 0))
    firsts = F.broadcast(spark.createDataFrame(list(enumerate(before)), "range int, _first long"))  # a row per range
    order = Window.partitionBy("range").orderBy("k", "d", "doc_id")
    out = with_range(whole, starts).withColumn("_rank", F.row_number().over(order) - 1).join(firsts, "range")
    return out.select("doc_id", "size", "text_crc32", F.floor(F.col("range") / ranges).cast("int").alias("shard"), (F.col("_rank") + F.col("_first")).cast("long").alias("slot"), *(["row"] if keep else []))


def write_shards(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """``docs`` written to the shared folder, a folder for each shard, and read back: (row, shard, slot,
    size, text_crc32), where ``row`` has all columns as they went through the exchange, and size and
    text_crc32 are those of the texts read back."""
    spark = docs.sparkSession
    out = shards_of(docs, shards, ranges, keep=True).select("row", "shard", "slot")
    path = common.new_path(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    read = spark.read.schema(out.schema).parquet(path)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")
    return read.withColumn("size", (F.octet_length(text) + 8).cast("long")).withColumn("text_crc32", F.crc32(text))


def op8_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_shards(common.load(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_histogram_sort_shards": op8_histogram_sort_shards}
ORACLE_SQL: dict[str, str] = {}
