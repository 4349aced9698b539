"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash; a pass over a source is its blocks in an
order permuted by another hash. A source's target gives whole passes and a share of one more,
which ends at a word of a document of a block, so the quota in words is exact. The quotas in
blocks of all sources are split among the output shards by a tree: at each node the left half
takes a multivariate-hypergeometric draw of the node's blocks, so that every shard has exactly
its share of blocks and, in expectation, the mixture. A shard draws its quota of a source as the
next run of blocks in the source's permuted order (disjoint between shards); a block that no
shard's quota reaches isn't drawn. The drawn documents are exchanged once, by shard and a range of
place (a hash), sorted by place and written; what was taken is counted in the shards read back.

Bounded on the driver: one row per source (at most MOST_SOURCES; more raise), the block table (at
most MOST_BLOCKS rows and one per source, whatever the size of the corpus) and the tree's quotas.

Handling of odd rows: a null text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0 and is taken 0 times; sources of one document may repeat
it up to three times; repeated rows are documents of their own, and of ties in a hash all are drawn alike; a null
doc_id is a value like any other; no rows give no rows. All columns are carried in ``mixed.row``, so their names clash with none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST_SOURCES = 100_000
MOST_BLOCKS = 65_536


def shares(sizes: np.ndarray, weights: np.ndarray, most: float = 3.0) -> np.ndarray:
    """Targets that sum to ``sizes``' sum, in proportion to weight, none above ``most`` times its
    size; the excess is shared anew by weight until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), sizes.sum()
    while open_.any():
        target[open_] = left * weights[open_] / weights[open_].sum()
        above = open_ & (target > most * sizes)
        if not above.any():
            break
        target[above] = most * sizes[above]
        open_ &= ~above
        left = sizes.sum() - target[~open_].sum()
    return target


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows); rows and columns sum exactly."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        mid = (low + high) // 2
        part = int(have.sum()) * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, part, method="marginals") if have.sum() else have
        split(low, mid, left)
        split(mid, high, have - left)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _sized(docs: DataFrame, keep: list, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, F.col("source").cast("string").alias("_source"), size.alias("_size"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)).alias("_h"))


#: Words of a shard that one task sorts, about.
RANGE_WORDS = 4_000_000


def _plan(slim: DataFrame, weights: tuple, shards: int, most: float, seed: int, tree) -> tuple[DataFrame, DataFrame, int]:
    """(sources, blocks, words): what is drawn. sources: _id, _source, source_size, target, _blocks
    and where the quota ends; blocks: _id, _block, _block_size, _quota (words of the last, broken
    pass) and _shards (that of each pass, null: not drawn). Statistics are from ``slim`` (_source,
    _size, _h of all rows)."""
    spark = slim.sparkSession
    found = slim.groupBy("_source").agg(F.sum("_size").alias("s")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r._source is None, r._source or ""))
    n = len(found)
    sizes = np.array([r.s for r in found], dtype=np.int64)
    target = shares(sizes, np.array([weights[i % len(weights)] for i in range(n)]), most)
    whole = np.where(sizes > 0, np.floor(target / np.maximum(sizes, 1)), 0).astype(np.int64)
    rest = np.maximum(np.rint(target).astype(np.int64) - whole * sizes, 0)
    parts = np.maximum(1, np.floor(MOST_BLOCKS * (sizes / max(1, int(sizes.sum())))).astype(np.int64))
    ids = F.broadcast(spark.createDataFrame([(i, r._source, int(parts[i])) for i, r in enumerate(found)], "_id int, _s string, _blocks long"))

    # Blocks without words are left out: nothing is drawn of them, and each place in the order counts.
    by_block = _placed(slim, ids).groupBy("_id", "_block").agg(F.sum("_size").alias("s")).filter("s > 0").select("_id", F.xxhash64("_block", "_id", F.lit(seed + 1)).alias("o"), "_block", "s").toArrow().sort_by([("_id", "ascending"), ("o", "ascending"), ("_block", "ascending")])
    source, size = by_block["_id"].to_numpy().astype(np.int64), by_block["s"].to_numpy()
    first = np.searchsorted(source, np.arange(n))
    nth = np.arange(len(source)) - first[source]  # place of the block in the permuted order
    upto = np.cumsum(size)
    before = upto - size - np.concatenate((upto, [0]))[first - 1][source] if len(source) else size
    quota = np.clip(rest[source] - before, 0, size)
    per_pass = np.bincount(source, minlength=n)
    broken = np.bincount(source, weights=quota > 0, minlength=n).astype(np.int64)
    # A shard draws the next blocks of each source, pass after pass, as many as its quota.
    stops = np.cumsum(tree(whole * per_pass + broken, shards, seed), axis=0)
    drawn = [[] for _ in range(len(source))]
    for p in range(int(whole.max(initial=0)) + 1):
        at = p * per_pass[source] + nth
        for i in np.flatnonzero((p < whole[source]) | (p == whole[source]) & (quota > 0)):
            shard = int(np.searchsorted(stops[:, source[i]], at[i], side="right"))
            drawn[i] += [None] * (p - len(drawn[i])) + [shard if shard < shards else None]
    blocks = spark.createDataFrame(pa.table({"_id": by_block["_id"], "_block": by_block["_block"], "_block_size": size, "_quota": quota.astype(np.int64), "_shards": pa.array(drawn, pa.list_(pa.int32()))}))

    # In the block of each source in which the quota ends, documents are taken in the order of their hash.
    ending = blocks.filter("_quota between 1 and _block_size - 1").select("_id", "_block", "_quota")
    inside = _placed(slim, ids).join(F.broadcast(ending), ["_id", "_block"]).groupBy("_id", "_quota", "_h").agg(F.sum("_size").alias("s"), F.count("*").alias("n"))
    so_far = F.sum("s").over(Window.partitionBy("_id").orderBy("_h"))
    ends_at = {r._id: r for r in inside.withColumn("upto", so_far).filter("upto >= _quota and upto - s < _quota").select("_id", "_h", ((F.col("_quota") - F.col("upto") + F.col("s")) / F.col("n")).cast("long").alias("part")).collect()}
    kinds = "_id int, _s string, source_size long, target double, _blocks long, _whole long, _end long, _part long"
    facts = [(i, r._source, int(sizes[i]), float(target[i]), int(parts[i]), int(whole[i]), *((ends_at[i]._h, ends_at[i].part) if i in ends_at else (None, None))) for i, r in enumerate(found)]
    return spark.createDataFrame(facts, kinds), blocks, int(sizes.sum())


def _placed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_source").withColumn("_block", F.pmod("_h", "_blocks"))


def _draw(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` (with _source, _size, _h) with draws: an array of (pass, words, shard)."""
    out = _placed(rows, F.broadcast(sources)).join(F.broadcast(blocks), ["_id", "_block"])
    size = F.col("_size")
    last = F.when(F.col("_quota") <= 0, 0).when((F.col("_quota") >= F.col("_block_size")) | (F.col("_h") < F.col("_end")), size).when(F.col("_h") == F.col("_end"), F.least(size, "_part")).otherwise(0)
    draws = F.transform("_shards", lambda shard, p: F.struct(p.alias("pass"), F.when(p < F.col("_whole"), size).otherwise(last).cast("long").alias("words"), shard.alias("shard")))
    return out.withColumn("draws", F.filter(draws, lambda d: (d["words"] > 0) & d["shard"].isNotNull()))


def _mixture(docs: DataFrame, weights: tuple, shards: int, most: float, seed: int, tree, more: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The drawn rows (row, pass, words, size, shard, place and ``more``) by shard and place, all rows'
    sizes with ``more``, and the sources."""
    spark = docs.sparkSession
    more = [c.alias(name) for name, c in more.items()]
    slim = common.materialise(_sized(docs, more, seed), "sizes")
    sources, blocks, words = _plan(slim, weights, shards, most, seed, tree)
    rows = _sized(docs, [common.whole(docs).alias("row"), F.col("doc_id").cast("long").alias("_doc"), *more], seed)
    drawn = _draw(rows, sources, blocks).withColumn("d", F.explode("draws"))
    drawn = drawn.select("row", "d.pass", "d.words", F.col("_size").alias("size"), "d.shard", F.xxhash64("_doc", "d.pass", F.lit(seed + 2)).alias("place"), *[c for c in slim.columns if c[0] != "_" or c == "_key"])
    ranges = max(1, -(-words // (shards * RANGE_WORDS)))
    part = F.floor(F.shiftrightunsigned("place", 33) * F.lit(ranges) / F.lit(1 << 31))
    dealt = drawn.repartition(max(common.tasks(spark), min(shards * ranges, 100_000)), "shard", part).sortWithinPartitions("shard", "place")
    return dealt, slim, sources


def mix(docs: DataFrame, weights: tuple = WEIGHTS, shards: int = 64, most: float = 3.0, seed: int = 11, tree=splitting_tree) -> DataFrame:
    """The mixture: ``mixed.row``, all columns of ``docs`` once for each draw, with ``mixed.pass``,
    ``mixed.words`` (below the document's size where the quota ends within it), ``mixed.size``,
    ``mixed.shard`` and ``mixed.place``. Rows are exchanged by shard and ranges of place and sorted,
    so that writing them writes shuffled shards. tree: of quotas, shards and seed, as ``splitting_tree``."""
    dealt, _, _ = _mixture(docs, weights, shards, most, seed, tree, {})
    return dealt.select(F.struct("row", "pass", "words", "size", "shard", "place").alias("mixed"))


def taken(docs: DataFrame, weights: tuple = WEIGHTS, shards: int = 64, most: float = 3.0, seed: int = 11, tree=splitting_tree) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``: the words that the
    mixture holds of it, repeats counted. The mixture is written to the shared folder, a folder for
    each shard with its documents in order of place, and read back. Rows equal in doc_id, source and
    text are drawn alike, so each has its share of what the shards hold of them."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    more = {"_key": F.xxhash64(F.lit(1), text.isNull(), text, source.isNull(), source), "doc_id": F.col("doc_id").cast("long")}
    dealt, slim, sources = _mixture(docs, weights, shards, most, seed, tree, more)
    out = dealt.select("row.text", "row.source", "doc_id", "_key", "pass", "words", "place", "shard")
    path = common.new_path(docs.sparkSession, "mixture")
    out.write.partitionBy("shard").parquet(path)
    copies = F.greatest(*[F.count_if(F.col("pass") == p) for p in range(int(most) + 1)], F.lit(1))  # a pass that draws one draws all
    held = docs.sparkSession.read.schema(out.schema).parquet(path).groupBy("_key", "doc_id").agg(F.sum("words").alias("words"), copies.alias("n")).select("_key", "doc_id", F.expr("words div n").alias("taken"))
    held = held.withColumnsRenamed({"_key": "_k", "doc_id": "_d"})
    every = slim.join(F.broadcast(sources.select("_s", "source_size", "target")), F.col("_source").eqNullSafe(F.col("_s")))
    every = every.join(held, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return every.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op3_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(common.load(spark, sf_dir, "documents"))


QUERIES = {"op3_hypergeometric_mix": op3_hypergeometric_mix}
ORACLE_SQL: dict[str, str] = {}
