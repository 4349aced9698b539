"""Packing token pieces into windows by non-negative least squares.

Documents are tokenized and cut into windows and a last piece. The lengths of pieces, rounded up
to units, give a histogram. All combinations of at most DEPTH lengths that fill a window exactly
are enumerated, and non-negative least squares finds how often to repeat each so that together
they use up the histogram (weighted by length). Repeats are rounded to what the histogram holds,
what is left is matched with the same combinations greedily, and the rest, which no combination
takes, is laid end to end and cut at windows, so that only its last window has padding.

Only the histogram and the chosen combinations are on the driver. Pieces are numbered by length
while they are made, so a piece finds its window by rank without a sort; windows with their ids
and the spans of documents in them are written, and placements are read from the windows.

Handling of odd rows: a null or empty text is one piece with the end id alone; documents that
repeat a doc_id are packed each; a null doc_id is kept; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoding import memo

WINDOW, UNIT, DEPTH = 2048, 8, 3
END_ID = 1


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Descending lengths, at most ``depth`` of them, that sum to ``units``."""

    def parts(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif depth:
            for first in range(min(left, most), -(-left // depth) - 1, -1):
                for rest in parts(left - first, first, depth - 1):
                    yield (first, *rest)

    return list(parts(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by active sets: the column with the steepest gain joins, columns
    that a least-squares fit makes negative leave."""
    x = np.zeros(a.shape[1])
    inside = np.zeros(a.shape[1], dtype=bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(most):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= scale:
            break
        inside[j] = True
        while True:
            at = np.flatnonzero(inside)
            fit = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[at] = fit
                break
            down = at[fit <= 0]
            ratio = x[down] / np.maximum(x[down] - fit[fit <= 0], 1e-300)
            x[at] += ratio.min() * (fit - x[at])
            inside[at[(x[at] <= 1e-12) | (at == down[ratio.argmin()])]] = False
            x[~inside] = 0
            if not inside.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) such that no length is used more often than the histogram has it.
    histogram[i]: pieces of i units; its last entry is a whole window."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    chosen: dict[tuple[int, ...], int] = {}

    def take(combo: tuple[int, ...], most: int) -> None:
        lengths, times = np.unique(combo, return_counts=True)
        n = int(min(most, (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            chosen[combo] = chosen.get(combo, 0) + n

    take((units,), int(left[units]))
    combos = [c for c in combinations(units, depth) if len(c) > 1 and all(histogram[i] for i in c)]
    if combos:
        a = np.zeros((units + 1, len(combos)))
        for j, c in enumerate(combos):
            np.add.at(a[:, j], list(c), 1)
        weight = np.arange(units + 1, dtype=float)
        top = max(1.0, float(left.max()))
        repeats = nnls(a * weight[:, None], left / top * weight) * top
        order = np.argsort(-repeats, kind="stable")
        for j in order:
            if repeats[j] > 0:
                take(combos[j], round(float(repeats[j])))
        for j in order:
            take(combos[j], int(left.max()))
    return sorted(chosen.items(), reverse=True)


def tokenize(docs: DataFrame, vocabulary_path: str, spaced: bool = False, window: int = WINDOW, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """Pieces of at most a window: part and nth (a piece's task, and its number among the task's
    pieces of as many units), before (the ids of those), doc_id, start, length, doc_tokens, units
    and ids (16-bit little-endian). Written to the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = memo(vocabulary_path, spaced), TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u2").tobytes()
        seen, upto = [0] * (window // unit + 1), [0] * (window // unit + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = words.encode(text or "") + tail
                total = len(raw) // 2
                for start in range(0, total, window):
                    ids = raw[2 * start : 2 * (start + window)]
                    n = len(ids) // 2
                    u = -(-n // unit)
                    for column, value in zip(out, (seen[u], upto[u], doc, start, n, total, u, ids)):
                        column.append(value)
                    seen[u] += 1
                    upto[u] += n
            rows = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.int32()), *(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.int32()), pa.array(out[7], pa.binary())], names=["part", "nth", "before", "doc_id", "start", "length", "doc_tokens", "units", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.materialise(rows.mapInArrow(run, "part int, nth long, before long, doc_id long, start long, length long, doc_tokens long, units int, ids binary"), "pieces", "zstd")


def pack(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """The windows of the pieces of ``tokenize``, written to the shared folder: sequence_id, ids
    (at most a window, 16-bit) and pieces, an array of (doc_id, start, length, doc_tokens) in order.

    A piece's rank among all of its units is its number within its task, after the pieces of the
    tasks before; ranks say which window it goes to. So nothing but the ids themselves is
    exchanged, once, by window. What tasks hold by units is a row per task."""
    spark = pieces.sparkSession
    units = window // unit
    each = common.materialise(pieces.groupBy("part", "units").agg(F.count("*").alias("n"), F.sum("length").alias("ids")), "counts")
    histogram = np.zeros(units + 1, dtype=np.int64)
    for r in each.groupBy("units").agg(F.sum("n").alias("n")).collect():
        histogram[r.units] = r.n
    used, windows, ranges = np.zeros(units + 1, dtype=np.int64), 0, []
    for combo, n in plan(histogram, depth):
        for place, u in enumerate(combo):
            ranges.append((int(u), int(used[u]), int(used[u] + n), windows, place))
            used[u] += n
        windows += n

    order = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = each.select("part", "units", *[F.coalesce(F.sum(c).over(order), F.lit(0)).cast("long").alias(c) for c in ("n", "ids")])
    at = lambda c: F.map_from_entries(F.collect_list(F.struct("units", c)))
    first = common.materialise(first.groupBy("part").agg(at("n").alias("_n"), at("ids").alias("_ids")).withColumnRenamed("part", "_part"), "first")
    limits = F.array(*[F.lit(int(n)) for n in used])
    ranked = pieces.join(first, F.col("part") == F.col("_part"))
    ranked = ranked.withColumn("rank", F.element_at("_n", F.col("units")) + F.col("nth")).withColumn("at", F.element_at("_ids", F.col("units")) + F.col("before")).drop("_part", "_n", "_ids", "part", "nth", "before")
    piece = F.struct("doc_id", "start", "length", "doc_tokens").alias("piece")

    table = F.broadcast(spark.createDataFrame(ranges, "_units int, low long, high long, base long, place int"))
    fitted = ranked.join(table, (F.col("units") == F.col("_units")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    fitted = fitted.select((F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("place").cast("long").alias("place"), piece, "ids")

    # The rest end to end, the longest first; where the rest of each units begins is one row.
    begins = {r.units: r.at for r in ranked.filter(F.col("rank") == F.element_at(limits, F.col("units") + 1)).select("units", "at").collect()}
    total = {r.units: r.ids for r in each.groupBy("units").agg(F.sum("ids").alias("ids")).collect()}
    shift, upto = [0] * (units + 1), 0
    for u in sorted(begins, reverse=True):
        shift[u] = upto - begins[u]
        upto += total[u] - begins[u]
    laid = ranked.filter(F.col("rank") >= F.element_at(limits, F.col("units") + 1)).withColumn("at", F.col("at") + F.element_at(F.array(*map(F.lit, shift)), F.col("units") + 1))
    laid = laid.withColumn("w", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window))))
    low, high = F.greatest(F.col("at"), F.col("w") * window) - F.col("at"), F.least(F.col("at") + F.col("length"), (F.col("w") + 1) * window) - F.col("at")
    laid = laid.withColumn("a", low).withColumn("b", high)
    cut = F.expr("substring(ids, int(2 * a) + 1, int(2 * (b - a)))")
    laid = laid.select((F.col("w") + windows).alias("sequence_id"), F.col("at").alias("place"), F.struct("doc_id", (F.col("start") + F.col("a")).alias("start"), (F.col("b") - F.col("a")).alias("length"), "doc_tokens").alias("piece"), cut.alias("ids"))

    parts = fitted.unionByName(laid).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "ids"))).alias("p"))
    ids = F.aggregate("p", F.expr("X''"), lambda a, p: F.concat(a, p["ids"]))
    return common.materialise(parts.select("sequence_id", ids.alias("ids"), F.col("p.piece").alias("pieces")), "windows", "zstd")


def placements(packed: DataFrame) -> DataFrame:
    """One row per piece of the windows of ``pack``, read from them: doc_id, start, length,
    ids_crc32 (of the ids that the window has there), doc_tokens, sequence_id, offset."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, ids, own = batch.columns
            flat = own.flatten()
            n = np.diff(own.offsets.to_numpy())
            length = flat.field("length").to_numpy()
            upto = np.cumsum(length)
            window = np.repeat(np.arange(len(n)), n)
            lead = np.concatenate(([0], upto))[np.cumsum(n) - n]
            offset = upto - length - lead[window]
            raw = [np.frombuffer(x, "<u2").astype("<u4") for x in ids.to_pylist()]
            crcs = [zlib.crc32(raw[w][a : a + k]) for w, a, k in zip(window.tolist(), offset.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([flat.field("doc_id"), flat.field("start"), flat.field("length"), pa.array(crcs, pa.int64()), flat.field("doc_tokens"), sequence.take(pa.array(window)), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return packed.select("sequence_id", "ids", "pieces").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` packed with the production vocabulary and window."""
    import public_tokenizers

    return placements(pack(tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(common.load(spark, sf_dir, "documents"))


QUERIES = {"op10_nnls_packing": op10_nnls_packing}
ORACLE_SQL: dict[str, str] = {}
