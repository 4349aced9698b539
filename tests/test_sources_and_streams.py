import datetime
import json
import os

from pyspark.sql import functions as F

from tamis.operators import runs
from tamis.sources import files, ris
from tamis.streaming import heartbeat
from tests.conftest import SF

RIS = """﻿TY  - JOUR
TI  - First part
T1  - second part
AU  - Doe, Jane
AU  - Roe, R.
PY  - 2024/05/01
AB  - An abstract
  that goes on
KW  - one
KW  - two
ER  - 
TY  - JOUR
AU  - No, Title
ER  - 
TI  - Merged
PY  - in press
ER  -
AU  - 王, 伟
TI  - again
ER  - 
TI  - Last without end
"""


def test_ris(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS, encoding="utf-8")
    (tmp_path / "b.ris").write_text("TI  - Other file\r\nDO  - 10.1/x\r\nER  - \r\n", encoding="utf-8")
    rows = {r.title: r for r in ris.read(spark, str(tmp_path)).collect()}
    assert set(rows) == {"First part second part", "Merged again", "Last without end", "Other file"}
    first = rows["First part second part"]
    assert first.authors == ["Doe, Jane", "Roe, R."] and first.keywords == ["one", "two"] and first.abstract == "An abstract that goes on" and first.year == 2024
    assert first.key.startswith("DoeJ_2024_") and rows["Merged again"].year == 0 and rows["Merged again"].key.startswith("伟_0_") and rows["Last without end"].key.startswith("_0_")
    s = ris.stats(ris.read(spark, str(tmp_path))).first()
    assert (s.total, s.has_abstract, s.has_doi, s.median_year) == (4, 1, 1, 2024)


def test_files(spark, tmp_path):
    records = tmp_path / "records" / "INCLUDE"
    os.makedirs(records)
    quote = "a quoted line that is long enough to count as evidence"
    (records / "u1.md").write_text(f"# u1\n\n### C\n> \"{quote}\"\n> short\ntext\n\n### O\noutcome\n---\n", encoding="utf-8")
    (records / "u2.md").write_text("**decision**: EXCLUDE\n", encoding="utf-8")
    got = {r.uid: r for r in files.markdown_records(spark, str(tmp_path / "records" / "*")).select("*", files.quotes(F.col("C")).alias("q")).collect()}
    assert got["u1"].decision == "INCLUDE" and got["u1"].q == [quote] and got["u1"].O.strip() == "outcome" and got["u2"].decision == "EXCLUDE"
    files.export_markdown(files.markdown_records(spark, str(tmp_path / "records" / "*")), str(tmp_path / "out"))
    assert {"decision=INCLUDE", "decision=EXCLUDE"} <= set(os.listdir(tmp_path / "out"))

    log = spark.createDataFrame([("[2026-01-02T03:04:05] 3/52 u7 p1 reused_success",), ("[2026-01-02T03:05:05] 4/52 u8 p1 attempt=2",), ("Traceback",)], "value string")
    assert [(r.event, r["index"], r.message) for r in files.progress_log(log).collect()] == [("reused", 3, None), ("attempt", 4, None), ("raw_log", None, "Traceback")]

    point = {"total_calls": 3, "calls": [{"uid": "a", "ok": True, "json_valid": True}, {"uid": "b", "ok": True, "json_valid": False}, {"uid": "c", "ok": True, "json_valid": True}]}
    files.write_json(point, str(tmp_path / "c.json"))
    (tmp_path / "broken.json").write_text("{no")
    row = files.calls(files.json_documents(spark, str(tmp_path / "c.json"), files.CHECKPOINT)).first()
    assert (row.total_calls, row.n_ok, row.n_failed, row.last_ok, row.last_failed) == (3, 2, 1, "c", "b")
    assert files.json_documents(spark, str(tmp_path / "broken.json"), files.CHECKPOINT).first()._corrupt_record.startswith("{no")

    lock = spark.createDataFrame([json.dumps({"total_included": 1, "records": [{"uid": "u"}, {"uid": "v"}]})], "string").select(F.from_json("value", files.LOCK).alias("l")).select("l.*")
    assert [(r.place, r.uid) for r in files.lock_records(lock).collect()] == [(0, "u"), (1, "v")]
    maps = spark.createDataFrame([('{"k1": "f1.pdf", "k2": "f1.pdf"}',)], "m string")
    assert sorted(map(tuple, files.binding_map(maps, "m").collect())) == [("k1", "f1.pdf"), ("k2", "f1.pdf")]

    (tmp_path / "v2.csv").write_text("﻿Key,Title\na,\"x\ny\"\n", encoding="utf-8")
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "v2.csv")).collect()] == [("a", "x\ny")]
    files.export_csv(files.csv(spark, str(tmp_path / "v2.csv")), str(tmp_path / "e"), {"Key": "键 key", "Title": "题 title"})
    assert files.csv(spark, str(tmp_path / "e")).columns == ["键 key", "题 title"]
    files.export_csv(spark.createDataFrame([("a", 2020)], "key string, year int"), str(tmp_path / "x"))
    assert len(files.csv(spark, str(tmp_path / "x")).columns) == 18 and next((tmp_path / "x").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    files.append_jsonl(spark.range(2), str(tmp_path / "j"))
    files.append_jsonl(spark.range(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    end = events.agg(F.max("ts")).first()[0]
    late = events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(end) + F.expr("interval 30 days")).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), "event_type", "value", "props")
    parts = tmp_path / "in"
    events.orderBy("ts").coalesce(1).write.parquet(str(parts / "a"))
    late.coalesce(1).write.parquet(str(parts / "b"))  # moves the watermark past all sessions
    stream = heartbeat.sessions(heartbeat.read(spark, str(parts / "*")))
    heartbeat.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("run >= 0")
    want = runs.sessions(events.withColumnRenamed("user_id", "run"))
    pick = lambda df: sorted((r.run, str(r.first_ts), str(r.last_ts), r.n) for r in df.collect())
    assert pick(got) == pick(want)

    seen = []
    query = heartbeat.each_batch(heartbeat.read(spark, str(parts / "*")), str(tmp_path / "cp2"), lambda batch, n: seen.append(batch.count()))
    query.awaitTermination()
    assert sum(seen) == events.count() + 1


class Upper:
    def pages(self, content, first):
        return content.decode("ascii").upper()[:first]


def test_texts_documents_and_backups(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "u 1.txt").write_text("one")
    (tmp_path / "txt" / "notes.md").write_text("no")
    assert [tuple(r) for r in files.texts(spark, str(tmp_path / "txt")).collect()] == [("u 1", "one")]
    (tmp_path / "pdf").mkdir()
    for name, data in (("a.pdf", b"abc"), ("b.pdf", b"\xff"), ("c.pdf", b"x" * 50)):
        (tmp_path / "pdf" / name).write_bytes(data)
    got = {r.path[-5:]: (r.text, r.problem) for r in files.documents(spark, str(tmp_path / "pdf"), Upper(), 2, most_bytes=40).collect()}
    assert got == {"a.pdf": ("AB", None), "b.pdf": (None, "UnicodeDecodeError"), "c.pdf": (None, "too large")}
    where = files.backup({"t": spark.range(3)}, str(tmp_path / "backups"), "v1")
    assert spark.read.parquet(where + "/t").count() == 3


def test_staleness_stream(spark, tmp_path):
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for i, rows in enumerate([[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:10")], [(2, "2024-01-01 00:20:00")], [(1, "2024-01-01 00:25:00"), (2, "2024-01-01 00:26:00")], [(9, "2024-01-01 02:00:00")], [(9, "2024-01-01 02:00:01")]]):
        data = [(i, datetime.datetime.fromisoformat(ts), user, "x", 0.0, "{}") for user, ts in rows]
        spark.createDataFrame(data, kinds).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    out = heartbeat.staleness(heartbeat.read(spark, str(tmp_path / "in" / "*")))
    heartbeat.to_table(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [(r.run, str(r.last_ts)[11:16], r.status) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("last_ts", "status").collect()]
    mine = [x[1:] for x in got if x[0] == 1]
    assert ("00:00", "running") in mine and ("00:00", "stale") in mine and ("00:25", "running") in mine and ("00:25", "stale") in mine
