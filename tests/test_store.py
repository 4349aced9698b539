import os
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

from tamis.operators.progress import last_wins
from tamis.operators.store import KeyedTable

ROW = StructType().add("k", "long").add("v", "string")
BATCH = "k long, v string, at int"


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_rewrite_only_their_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=8)
    assert table.version() == 0 and table.read().count() == 0 and table.find(1).count() == 0
    pick = random.Random(2)
    whole = spark.createDataFrame([], ROW)
    for n, size in enumerate([200, 3, 60, 1], 1):
        rows = [(pick.randint(0, 150), f"{n}:{i}", i) for i in range(size)]
        batch = spark.createDataFrame(rows + [(None, "no key", 0)], BATCH)
        before, seen = files_of(tmp_path), table.folders()
        assert table.upsert(batch, "at") == n
        whole = spark.createDataFrame(last_wins(whole, batch.filter("k is not null"), "k", "at").collect(), ROW)
        assert sorted(table.read().collect()) == sorted(whole.collect())
        after = files_of(tmp_path)
        assert all(after[f] == t for f, t in before.items())  # nothing that was there is touched
        changed = {b for b, f in table.folders().items() if seen.get(b) != f}
        touched = {r[0] for r in batch.filter("k is not null").select(table._bucket(batch.k)).collect()}
        assert changed == touched
    assert [tuple(r) for r in table.find(rows[0][0]).collect()] == [(rows[0][0], "4:0")]
    assert table.read(1).count() == len({r.k for r in table.read(1).collect()}) and table.read(1).filter("v like '1:%'").count() == table.read(1).count()
    assert table.upsert(spark.createDataFrame([(None, "x", 1)], BATCH), "at") == 4


def test_a_second_writer_and_a_broken_one(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=4)
    table.upsert(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], BATCH), "at")
    late = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=4)
    monkeypatch.setattr(KeyedTable, "version", lambda self: 1)  # both start from the first version
    table.upsert(spark.createDataFrame([(1, "c", 0)], BATCH), "at")
    with pytest.raises(AnalysisException):
        late.upsert(spark.createDataFrame([(2, "d", 0)], BATCH), "at")
    monkeypatch.undo()
    assert sorted(map(tuple, table.read().collect())) == [(1, "c"), (2, "b")]
    monkeypatch.setattr(KeyedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(1, "e", 0)], BATCH), "at")
    monkeypatch.undo()
    assert sorted(map(tuple, table.read().collect())) == [(1, "c"), (2, "b")] and table.upsert(spark.createDataFrame([(1, "f", 0)], BATCH), "at") == 3
