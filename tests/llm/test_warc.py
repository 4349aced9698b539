import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import StructType

from tamis.llm import common, warc

BIG = "<p>é</p>" * 200
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, None), (4, "http://ü b\r\nX: y", ""), (5, "http://a/5", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 50),
        (6, "http://a/6", "x" * 999), (7, "http://a/7", "x" * 999), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (9, "u", "y" * 1000), (None, "u", "y" * 1000), (10, "v", BIG), (2**40, "w", "ab\r\n\r\n" * 100000)]


def expected(rows):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and page is not None and page < top[html]
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[html] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archive(spark):
    warc.register(spark)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    path = common.new_path(spark, "w")
    warc.write_warc(pages, path)
    return path


def test_round_trip(spark, archive):
    got = spark.read.format("warc").load(archive).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    assert {r.target_uri for r in got if r.page_id == 4} == {"http://%C3%BC%20b%0D%0AX:%20y"}


def test_filters_reach_the_reader(spark, archive):
    df = spark.read.format("warc").load(archive).filter("record_type = 'response' and page_id > 4 and payload_bytes < 1000")
    assert sorted(r.page_id for r in df.collect()) == [6, 7]
    assert "PushedFilters: []" not in df._jdf.queryExecution().executedPlan().toString()
    reader = warc.WarcReader(StructType.fromDDL(warc.SCHEMA), {"path": archive})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 6), In(("payload",), (b"x",))]))
    assert len(left) == 1
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == reader.inflated == 5  # page 7, both rows of 9, 10 and the largest
    heads = warc.WarcReader(StructType.fromDDL("page_id long, record_type string"), {"path": archive})
    assert len([r for p in heads.partitions() for r in heads.read(p)]) == len(ROWS) and heads.inflated == 0


def test_plan_and_damage(archive):
    assert warc.plan([("c", 5), ("a", 3), ("b", 6), ("d", 50)], 10) == [["a", "b"], ["c"], ["d"]]
    data = bytearray(warc.member(warc.record(1, "u", b"abc" * 500, None, "d")))
    data[-8] ^= 1
    with pytest.raises(ValueError):
        list(warc.WarcReader(StructType.fromDDL(warc.SCHEMA), {"path": "/x", "verify": "true"}).rows(io.BytesIO(bytes(data))))


def test_query_and_no_rows(spark):
    got = warc.op2_warc_source(spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected([(p.page_id, p.url, p.html) for p in pages])
    path = common.new_path(spark, "none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert spark.read.format("warc").load(path).count() == 0
    assert spark.read.format("warc").load(path + "-never-written").count() == 0


def foreign():
    """Records as other tools write them: several types, no payload length, base32 digests."""
    body = b"<p>" + bytes(range(256)) * 40
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    kinds = [("warcinfo", "application/warc-fields", b"software: x\r\n\r\nmore", None), ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n", None), ("response", "application/http; msgtype=response", http, sha), ("metadata", "text/plain", b"", None), ("conversion", "text/plain", body[3:], None)]
    out = []
    for i, (kind, mime, block, digest) in enumerate(kinds):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", "WARC-Target-URI: http://x/", f"Content-Type: {mime}", *([f"WARC-Payload-Digest: {digest}"] if digest else []), f"Content-Length: {len(block)}", "", ""]
        out.append("\r\n".join(lines).encode() + block + b"\r\n\r\n")
    return out, body


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_archives_of_others(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    records, body = foreign()
    ours = warc.member(warc.record(77, "http://y/", b"own" * 900, None, "d"))
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "d.warc.gz").write_bytes(ours + b"".join(map(gzip.compress, records)))
    (tmp_path / "e.warc.gz").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    reader = lambda schema, **o: warc.WarcReader(StructType.fromDDL(schema), {"path": str(tmp_path), "partitionbytes": "1", **o})
    one = reader("record_type string, payload_digest string, payload_bytes long, payload binary", verify="true")
    got = [r for p in one.partitions() for r in one.read(p)]
    assert len(got) == 21 and [r for r in got if r[3] == b"own" * 900][0][2] == 2700
    assert [r[:2] for r in got if r[0] == "response" and r[3] == body] == [("response", hashlib.sha1(body).hexdigest())] * 4
    assert sum(r[3] == body[3:] for r in got) == 4 and sum(r == ("metadata", None, 0, b"") for r in got) == 4
    heads = reader("record_type string, target_uri string")
    assert list(heads.pushFilters([EqualTo(("record_type",), "response")])) == []
    assert sorted(r for p in heads.partitions() for r in heads.read(p)) == [("response", "http://x/")] * 4 + [("response", "http://y/")] and heads.inflated == 0
    warc.register(spark)
    assert spark.read.format("warc").load(str(tmp_path)).groupBy("record_type").count().count() == 5
    with pytest.raises(ValueError):
        list(reader("record_type string, payload binary").rows(io.BytesIO(b"".join(records)[:-5000])))


def test_files_roll_and_unwanted_members_are_not_read(spark):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 30000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = common.new_path(spark, "roll")
    warc.write_warc(pages, path, roll=300)
    reader = warc.WarcReader(StructType.fromDDL("page_id long"), {"path": path})
    files = [n for p in reader.partitions() for n in p.names]
    assert len(files) > 3 and sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == list(range(20))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    import os

    data = b"".join(warc.member(warc.record(i, "u", os.urandom(1 << 20), None, "d")) for i in range(8))
    source = Counted(data)
    assert len(list(reader.rows(source))) == 8 and source.taken < len(data) / 2
