"""Connected components over edges that stay distributed: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mins(pairs: DataFrame, name: str) -> DataFrame:
    """Smallest neighbour by node, as a table: the join with it can then split hot nodes."""
    return common.materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), name)


def _stats(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); component: the smallest node reachable.

    No edges give no rows. Self-loops and repeated edges are harmless. Each round is written to
    the shared folder; only a count and a checksum come to the driver.
    """
    now = common.materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _stats(now)
    for _ in range(most):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _mins(both, "mins").select("u", F.least("u", "m").alias("m"))
        star = common.materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = _mins(star, "mins")
        down = star.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.materialise(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _stats(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
