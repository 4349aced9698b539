import random

from pyspark.sql import functions as F

from tamis.sources import ris


def library(n, end, seed=3):
    pick = random.Random(seed)
    words = ["naïve", "Ärzte", "虚拟", "trial", "of", "reality", "é" * 40, "x  y"]
    out = []
    for i in range(n):
        title = " ".join(pick.choice(words) for _ in range(pick.randint(1, 12)))
        lines = ["TY  - JOUR", f"TI  - {title} {i}"] + [f"AU  - Name{pick.randint(0, 9)}, {pick.choice('ABé')}." for _ in range(pick.randint(0, 3))]
        lines += [f"PY  - {pick.randint(1990, 2024)}", "AB  - " + "long " * pick.randint(0, 200), "  goes on", "\tand on"] if pick.random() < 0.5 else ["", "stray line", "KW  - one", "KW  - two"]
        out += lines + ["ER  - "]
    return end.join(out) + end


def rows(df):
    return sorted(str(r) for r in df.drop("path", "block", "row", "record").collect())


def test_a_large_file_is_cut_at_records_into_many_partitions(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, end in (("unix", "\n"), ("windows", "\r\n")):
        (tmp_path / f"{name}.ris").write_bytes(("﻿" + library(200, end)).encode())
        whole = ris.parse(spark.read.text(str(tmp_path / f"{name}.ris"), wholetext=True).select(F.col("value").alias("content")))
        want = rows(whole)
        assert len(want) == 200
        for size in ("1009", "1m"):  # cuts fall within characters, tags and end lines
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            try:
                got = ris.read(spark, str(tmp_path / f"{name}.ris"))
                assert rows(got) == want
                assert size == "1m" or got.rdd.getNumPartitions() > 20
                order = [r.title for r in got.orderBy("path", "block", "row", "record").collect()]
                assert [int(t.split()[-1]) for t in order] == list(range(200))
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", old)
                spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bare_carriage_returns_empty_files_and_text_on_the_end_line(spark, tmp_path):
    (tmp_path / "mac.ris").write_bytes(library(5, "\r").encode())
    (tmp_path / "empty.ris").write_bytes(b"")
    (tmp_path / "rest.ris").write_bytes(b"TI  - a\nER  - end of a\nTI  - b\nER  - \n\n")
    got = ris.read(spark, str(tmp_path))
    assert got.count() == 7 and {"a", "b"} <= {r.title for r in got.collect()}


def test_stream_equals_batch_and_import_takes_the_first_of_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.ris").write_text(library(40, "\n", seed=i % 2), encoding="utf-8")
    stream = ris.read_stream(spark, str(tmp_path / "in"), files=1)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = ris.read(spark, str(tmp_path / "in"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
    known = batch.limit(1).select("key")
    new = ris.new_records(batch, known).collect()
    keys = {r.key for r in batch.collect()}
    assert len(new) == len(keys) - 1 and {r.key for r in new} == keys - {known.first().key}
    assert all(r.path.endswith(("0.ris", "1.ris")) for r in new)  # the third repeats the first


def test_no_exchange_and_unused_fields_are_not_computed(spark, tmp_path):
    (tmp_path / "a.ris").write_text(library(5, "\n"), encoding="utf-8")
    plan = ris.read(spark, str(tmp_path)).select("title")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Exchange" not in physical and "AB" not in physical.replace("JOUR", "")
