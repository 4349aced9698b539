"""Language ID by hyperdimensional profiles.

Each letter of any script, and the gap between words, has a random vector of +1 and -1, drawn by a
seeded hash of its code point. A trigram's vector binds those of its letters, permuted by place
(rotated by two, one and no places) and multiplied. A document bundles (sums) the vectors of its
trigrams, a language those of its training documents. A document is of the language with the
largest cosine. Letters are lower-cased. Bundles are whole numbers, so prototypes do not depend on
partitions.

Whether a document is of its best language at all is told by the language's own documents: those
of like length (a power of two of letters) have a median cosine, and a document with less than
LEAST_SHARE of it is rejected.

Handling of odd rows: a null text, or one without letters, is ``und`` with score 0; so is every
text where nothing was learned (no rows, or no lang). Ties go to the least lang by code point.
Repeated rows are learned as often as they occur. Columns other than doc_id, text and lang are
not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, hashing

DIMENSIONS, SEED = 1024, 20240229
#: Languages learned at most (more raise); prototypes are broadcast (4 kB each).
MOST_LANGUAGES = 16_384
#: Share of the median cosine of a language's documents of like length that a document needs.
LEAST_SHARE = 0.5
UNKNOWN = "und"
_DOCS, _CHARS, _GRAMS, _CODES = 256, 1 << 19, 4096, 1 << 20
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _TABLE:
        _TABLE.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _TABLE[0]


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> list[np.ndarray]:
    """Vectors of the letters with these code points (0: the gap) as first, second and third of a
    trigram: the bits of a hash of seed, code point and place in the vector."""
    place = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = hashing.mix(hashing.mix(points.astype(np.uint64) + np.uint64(seed << 24))[:, None] + place * hashing.BYTE_BASE)
    base = np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions].astype(np.int8) * 2 - 1
    return [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """One row per text: the sum of its trigrams' vectors (zero where it has no letter); and its letters."""
    out, n = np.zeros((len(texts), dimensions), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
    lowered = [(t or "").lower() for t in texts]
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and b - a < _DOCS and (b == a or size + len(lowered[b]) <= _CHARS):
            size += len(lowered[b])
            b += 1
        out[a:b], n[a:b] = _bundle(lowered[a:b], dimensions)
        a = b
    return out, n


def _bundle(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    line = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in texts)])  # a text has the gap after it
    letters = np.bincount(owner[letter], minlength=len(texts) + 1)[1:]
    known = np.concatenate(([0], np.flatnonzero(np.bincount(points[letter]))))  # 0 is the gap
    number = np.zeros(int(known[-1]) + 1, dtype=np.int64)
    number[known] = np.arange(len(known))
    s = np.zeros(len(points), dtype=np.int64)
    s[letter] = number[points[letter]]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    s, owner = s[keep], owner[keep]
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    if len(s) < 3:
        return out, letters
    many = len(known)
    inner = s[1:-1] != 0
    gram = (s[:-2] * many + s[1:-1]) * many + s[2:]
    gram, doc = gram[inner], owner[1:-1][inner] - 1
    if many**3 <= _CODES:  # a table is quicker than a sort
        table = np.zeros(many**3, dtype=np.int64)
        table[gram] = 1
        grams = np.flatnonzero(table)
        table[grams] = np.arange(len(grams))
        place = table[gram]
    else:
        grams, place = np.unique(gram, return_inverse=True)
    vectors = letter_vectors(known, dimensions)
    for low in range(0, len(grams), _GRAMS):
        g = grams[low : low + _GRAMS]
        bound = vectors[0][g // many**2] * vectors[1][g // many % many] * vectors[2][g % many]
        here = (place >= low) & (place < low + _GRAMS) if len(grams) > _GRAMS else slice(None)
        counts = np.bincount(doc[here] * len(g) + place[here] - low, minlength=len(texts) * len(g)).reshape(len(texts), len(g))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out, letters


def fit(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype by language, of unit length, from the text and lang of all rows of ``docs``.

    Tasks bundle by language; bundles are summed by language and dimension, so what reaches the
    driver is languages times dimensions, whatever the size of the corpus.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for low in range(0, len(langs), _DOCS):
                names = sorted(set(langs[low : low + _DOCS]))
                which = np.array([[lang == name for lang in langs[low : low + _DOCS]] for name in names], dtype=np.float64)
                for name, row in zip(names, which @ bundles(batch.column(0).slice(low, _DOCS).to_pylist(), dimensions)[0]):
                    sums[name] = sums.get(name, 0) + np.rint(row).astype(np.int64)
        for name, row in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(row), "d": pa.array(range(len(row)), pa.int32()), "v": row})

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "v")))["v"].alias("v"))
    found = whole.limit(MOST_LANGUAGES + 1).toArrow()  # a row of numbers for each language
    if found.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {lang: np.array(v, dtype=np.float64) for lang, v in zip(found["lang"].to_pylist(), found["v"].to_pylist())}
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(out.items()) if v.any()}


def _classify(texts: list[str | None], prototypes: dict[str, np.ndarray], dimensions: int) -> tuple[list[str], list[float], list[int]]:
    """Language, cosine and number of letters of each text."""
    names = list(prototypes)
    langs: list[str] = []
    scores: list[float] = []
    letters: list[int] = []
    weights = np.stack([prototypes[k] for k in names], axis=1) if names else None
    for low in range(0, len(texts), _DOCS):
        v, n = bundles(texts[low : low + _DOCS], dimensions)
        size = np.linalg.norm(v, axis=1)
        cosine = np.round((v @ weights) / np.maximum(size, 1e-9)[:, None], 6) if names else np.zeros((len(v), 1))
        some = (size > 0) & bool(names)
        langs += [names[j] if ok else UNKNOWN for j, ok in zip(cosine.argmax(1), some)]
        scores += np.where(some, np.clip(cosine.max(1), 0, 1), 0.0).tolist()
        letters += n.tolist()
    return langs, scores, letters


def language_of(prototypes: dict[str, np.ndarray]):
    """A column function of a text: struct of lang_pred, score and letters. Only texts go to Python."""
    dimensions = len(next(iter(prototypes.values()), [0] * DIMENSIONS))

    @F.pandas_udf("lang_pred string, score double, letters long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            langs, scores, letters = _classify(part.tolist(), prototypes, dimensions)
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "letters": letters})

    return of


def keep_known(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` whose profile is like that of a language learned from its text and lang:
    texts without letters go, and those with less than ``least`` of the median cosine that the
    predicted language's own documents (lang is what is predicted) of like length have. Where it
    has none of that length, those of the nearest length count. Texts are profiled once: rows
    wait with their cosines in the shared folder, and are never exchanged."""
    row = common.whole(docs).alias("_row")
    found = docs.select(row, F.col("lang").cast("string").alias("_lang"), language_of(fit(docs))(F.col("text").cast("string")).alias("_f"))
    found = common.materialise(found.select("_row", "_lang", "_f.*").withColumn("_size", F.floor(F.log2(F.greatest("letters", F.lit(1)))).cast("int")), "profiles", "zstd")
    # A cosine is counted by the thousandth, so a language has at most 64 lengths of 1001 counts.
    own = found.filter("_lang = lang_pred").groupBy("lang_pred", "_size", F.round("score", 3).alias("c")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang_pred", "_size")
    own = own.withColumn("upto", F.sum("n").over(w.orderBy("c"))).withColumn("all", F.sum("n").over(w)).filter("2 * upto >= all")
    medians = {(r.lang_pred, r._size): r.m for r in own.groupBy("lang_pred", "_size").agg(F.min("c").alias("m")).collect()}
    cuts = [(lang, size, least * medians[min(((k, s) for k, s in medians if k == lang), key=lambda x: (abs(x[1] - size), x[1]))]) for lang in {k for k, _ in medians} for size in range(64)]
    cuts = F.broadcast(found.sparkSession.createDataFrame(cuts, "_l string, _s int, _cut double"))
    out = found.filter(F.col("lang_pred") != UNKNOWN).join(cuts, (F.col("lang_pred") == F.col("_l")) & (F.col("_size") == F.col("_s")), "left")
    return out.filter(F.col("score") >= F.coalesce("_cut", F.lit(0.0))).select("_row.*")


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (by default doc_id) with lang_pred and score, the cosine (0 at least)."""
    dimensions = len(next(iter(prototypes.values()), [0] * DIMENSIONS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            langs, scores, _ = _classify(batch.column(n).to_pylist(), prototypes, dimensions)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=out.fieldNames())

    rows = docs.select(*([F.col("doc_id").cast("long").alias("doc_id")] if keep is None else keep), F.col("text").cast("string").alias("_text"))
    from pyspark.sql.types import DoubleType, StringType, StructType

    out = StructType(rows.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(run, out)


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    held_out = common.crc_mod("doc_id", 3) == 1
    prototypes = fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    return predict(docs, prototypes).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_hyperdimensional_language": op7_hyperdimensional_language}
ORACLE_SQL: dict[str, str] = {}
