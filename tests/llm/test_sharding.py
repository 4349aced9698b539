import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamis.llm import sharding


def check(got, rows, shards, slack):
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    mean = sum(size.values()) / shards
    assert all(abs(size[s] - mean) <= slack for s in range(shards)), (mean, dict(size))
    return size


@pytest.mark.parametrize("shards,ranges", [(24, 8), (5, 1)])
def test_near_equal_bytes_with_hot_copies(spark, shards, ranges):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(10_000 + i, "copy of a text " * 10) for i in range(5000)] + [(-7, None), (None, ""), (2**62, "é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("k", F.lit("x")).repartition(6)
    got = sharding.shards_of(df, shards, ranges).collect()
    largest = max(len((t or "").encode()) + 8 for _, t in docs)
    check(got, docs, shards, 2 * largest)
    where = sorted({r.shard for r in got if r.text_crc32 == zlib.crc32(b"copy of a text " * 10)})
    assert where == list(range(where[0], where[-1] + 1))
    assert [r.asDict() for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [r.asDict() for r in sorted(sharding.shards_of(df.repartition(2), shards, ranges).collect(), key=lambda r: (r.shard, r.slot))]
    kept = sharding.shards_of(df, shards, ranges, keep=True)
    assert kept.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "row"] and kept.select("row.*").columns == df.columns and kept.count() == len(docs)


def test_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("size", "Shard", "slot", "text_crc32", "range", "row", "k", "_keep", "a.b", "_rank"):
        docs = docs.withColumn(name, F.lit(name))
    out = sharding.write_shards(docs)
    assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, docs.collect()))


def test_splitters_are_exact(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.keyed(df)
    total, starts, rounds = sharding.splitters(rows, 7, 1, 0.0005)
    assert total == 20000 * 12 and len(starts) == 6 and rounds > 2
    assert len({s[0] for s in starts}) == 1


def test_ranges_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_BYTES", 2000)
    monkeypatch.setattr(sharding, "MOST_COUNTS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen = []
    plain = sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda rows, shards, ranges, tolerance: seen.append(ranges) or plain(rows, shards, ranges, tolerance))
    check(sharding.shards_of(docs, 3).collect(), rows, 3, 2 * max(len(t.encode()) + 8 for _, t in rows))
    assert seen[0] > 3 * sharding.RANGES


def test_odd_tables(spark):
    one = spark.createDataFrame([(1, "a")] * 50, "doc_id long, text string")
    got = sharding.shards_of(one).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(50))
    assert sharding.shards_of(one.limit(0)).count() == 0
    assert sharding.op8_histogram_sort_shards(spark, "/root/testdata/sf0.001").columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_shards_hold_the_documents(spark, monkeypatch):
    paths, new_path = [], sharding.common.new_path
    monkeypatch.setattr(sharding.common, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    got = sharding.op8_histogram_sort_shards(spark, "/root/testdata/sf0.001").collect()
    path = next(p for p in paths if "/shards-" in p)
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = spark.read.parquet(path).collect()
    assert sorted((r.row.doc_id, r.row.text, r.row.lang, r.row.source) for r in held) == sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.values())
    assert {(r.row.doc_id, r.shard, r.slot) for r in held} == {(r.doc_id, r.shard, r.slot) for r in got}
    check(got, [(d, r.text) for d, r in docs.items()], 24, 2 * max(len(r.text.encode()) + 8 for r in docs.values()))
    assert sharding.write_shards(spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")).count() == 2
