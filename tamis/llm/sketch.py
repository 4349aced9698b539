"""Document fingerprints by threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space. So sketches of texts
of any length share one scale: the union of sketches is the sketch of the union (they merge by
sorting together), and shared hashes over own hashes estimate containment even between a note
and a book: of a text that is wholly within another every kept hash is shared. The fraction is one
in SCALE for every text, so of a text of s shingles nothing is kept with probability
(1 - 1 / SCALE) ** s (10 % at 8 shingles, 1 % at 16); such a text has an empty
sketch like a wordless one, and beside it a mark, a hash of the set of all its shingles, by which it is told
from other such texts: equal (1.0) or not (0.0). Shingles are five words, ASCII letters lower-cased.

Handling of odd rows: null is an empty text; wordless texts are alike (1.0) and contained in any
(1.0), an empty and a filled sketch are not alike (0.0); columns other than doc_id and text are not looked at, so any names may be there; a text of fewer words than a shingle is one shingle; documents that repeat a
doc_id follow one another in order of text; a null doc_id sorts first; a single document is its own
next; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, hashing

SHINGLE, SCALE = 5, 4


def sketches(texts: pa.Array, k: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted hashes kept of each text."""
    return marked(texts, k, scale)[0]


def marked(texts: pa.Array, k: int = SHINGLE, scale: int = SCALE) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted hashes kept of each text, and its mark: a hash of the set of all its shingles (0: none)."""
    out: list[np.ndarray] = []
    marks = np.zeros(len(texts), dtype=np.uint64)
    least = np.uint64((1 << 64) // scale)
    for a, b in hashing.chunks(texts):
        data, offsets = hashing.raw(texts[a:b])
        data = hashing.LOWER[data]
        start, end, owner = hashing.find_words(data, offsets)
        h, owner = hashing.shingles(hashing.span(hashing.prefix(data), start, end), owner, k)
        keep = h < least
        few = np.bincount(owner[keep], minlength=b - a) == 0  # only their marks are asked for
        for i, own in _by_owner(h[few[owner]], owner[few[owner]], b - a):
            if len(own):
                marks[a + i] = hashing.mix(np.bitwise_xor.reduce(hashing.mix(own))[None])[0] | np.uint64(1)
        out += [own for _, own in _by_owner(h[keep], owner[keep], b - a)]
    return out, marks


def _by_owner(h: np.ndarray, owner: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct hashes of each of ``n`` texts."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return enumerate(np.split(h, np.searchsorted(owner, np.arange(1, n))))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both sets of shingles together."""
    return np.union1d(a, b)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray, mark_a: int = 0, mark_b: int = 0) -> float:
    """Estimated resemblance: shared hashes over all hashes. Of two texts of which nothing is kept the
    marks say whether their shingles are the same (1.0) or not (0.0)."""
    if not len(a) and not len(b):
        return float(mark_a == mark_b)
    n = shared(a, b)
    return n / (len(a) + len(b) - n)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that are in the second."""
    return shared(a, b) / len(a) if len(a) else 1.0


def to_text(sketch: np.ndarray, mark: int = 0) -> str:
    """The kept hashes in hex; where there are none, ``=`` and the mark (nothing for wordless texts)."""
    return sketch.astype(">u8").tobytes().hex() if len(sketch) or not mark else f"={int(mark):016x}"


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("" if text[:1] == "=" else text), dtype=">u8").astype(np.uint64)


def interval(column: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at or below the column: a balanced tree of tests."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column >= bounds[mid], tree(mid + 1, high)).otherwise(tree(low, mid))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that hash partitioning deals to it, so that ranges
    numbered by these keys meet in no partition."""
    ids = spark.range(0, 40 * n).select(F.col("id").cast("int").alias("key"))
    found = {r.p: r.key for r in ids.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key")).collect()}
    return [found.get(p, 40 * n + p) for p in range(n)]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, border, doc_id, text) for ``pairs``: documents dealt by ranges of doc_id and
    sorted, each range followed by a copy of the document that comes next. One exchange of the
    texts; the bounds and the first ids of the ranges are as many as partitions."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = common.tasks(spark)
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first().q or []
    keys = partition_keys(spark, n)
    part = interval(F.col("doc_id"), sorted(set(found)))
    key = F.element_at(F.array(*map(F.lit, keys)), part + 1)
    firsts = sorted(rows.groupBy(part.alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first")).select("part", "first.doc_id").collect())
    heads = [(x.doc_id, keys[firsts[i - 1].part], i == 0) for i, x in enumerate(firsts)]
    heads_df = F.broadcast(spark.createDataFrame(heads, "_id long, _to int, wraps boolean"))
    one = Window.partitionBy("doc_id", "_to").orderBy("text")
    copies = rows.join(heads_df, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(F.col("_to").alias("part"), F.lit(True).alias("border"), "doc_id", "text")
    dealt = rows.select(key.alias("part"), F.lit(False).alias("border"), "doc_id", "text").unionByName(copies)
    return dealt.repartition(n, "part").sortWithinPartitions("part", "border", "doc_id", "text")


def neighbours(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the second half replaced by the
    beginning of the next document), and their likeness to it and to the next document's."""
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_in_this double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for a, b in hashing.chunks(batch.column(3)):
                rows = batch.slice(a, b - a)
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                held = rows.slice(rows.num_rows - 1)
                parts, border, ids, texts = (c.to_pylist() for c in rows.columns)
                own = [i for i in range(len(ids) - 1) if not border[i]]
                if not own:
                    continue
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
                prints, marks = marked(rows.column(3), k, scale)
                changed, other = marked(pa.array(edited, pa.string()), k, scale)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([to_text(prints[i], marks[i]) for i in own]), pa.array([to_text(c, m) for c, m in zip(changed, other)]), pa.array([likeness(prints[i], c, marks[i], m) for i, c, m in zip(own, changed, other)]),
                    pa.array([likeness(prints[i], prints[i + 1], marks[i], marks[i + 1]) for i in own]), pa.array([containment(prints[i + 1], prints[i]) if len(prints[i + 1]) or not marks[i + 1] else float(marks[i] == marks[i + 1]) for i in own]),
                ], names=[x.split()[0] for x in kinds.split(", ")])

    return with_next(docs).mapInArrow(run, kinds)


def op6_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(common.load(spark, sf_dir, "documents"))


QUERIES = {"op6_threshold_sketch": op6_threshold_sketch}
ORACLE_SQL: dict[str, str] = {}
