"""WARC archives: a writer, and a Python data source that reads headers first.

Archives are written as ``.warc.gz`` with one gzip member per record, at most ROLL bytes a file, so
that a file is work for one task. A member's header has an extra field ``sl`` with the lengths of
the member and of what it holds, so a reader jumps over a record after its WARC header without
reading or inflating the rest. Archives of others are read too: ``.warc.gz`` of any gzip members is
inflated as a stream, of which unwanted payloads are passed over but not kept, and in ``.warc`` they
are skipped by Content-Length. Records of all types are rows; digests in base32 are given as hex.

``spark.read.format("warc").schema(...).load(path)`` has the columns of SCHEMA, or those of them
that the given schema names. Partitions are planned from file sizes: small files share one.
Filters on columns that the WARC header holds are pushed into the reader (with
``spark.sql.python.filterPushdown.enabled``, which ``register`` sets); payloads of other records,
and all payloads where the schema has none, stay compressed. With option ``verify`` each payload
is inflated and held against length and digest of its header. Where the header has no length of
the payload, it is that of the block (revisits: null); HTTP headers are not part of a payload.

Handling of odd rows: a null html is an empty payload, a null or odd url is written percent-encoded;
a null page_id has an empty record number, reads back null and is a response; rows that repeat a page_id with its
payload are all responses (none has a larger page_id); no rows write no archive, and a folder without
archives has no rows; a record cut off at the end of an archive is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from . import common
from .files import filesystem, write_file

SCHEMA = "record_type string, record_id string, page_id long, target_uri string, date string, refers_to long, payload_digest string, payload_bytes long, payload binary"
LEAST_BYTES, ROLL = 1000, 128 << 20
#: Bytes read at once, and at first of a record.
CHUNK, HEAD = 1 << 18, 1 << 12
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"
_MEMBER = struct.Struct("<BBBBIBBHBBHII")  # gzip header with one extra subfield of two lengths


def member(data: bytes) -> bytes:
    """One gzip member with its lengths in the header."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 12, ord("s"), ord("l"), 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or with ``refers_to`` a revisit record without the payload."""
    name = "" if page_id is None else str(page_id)
    uri = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{name}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit the payload of a larger page_id.

    Digests are counted in part before the exchange; only those that repeat are looked up again,
    from a table, so that a digest with a large share of the rows can be split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes")).filter(F.col("bytes") >= least).drop("bytes")
    repeated = common.materialise(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "digests")
    return slim.join(repeated, "digest").filter("page_id < refers_to")


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_BYTES, roll: int = ROLL) -> None:
    """Writes each row of ``pages`` (page_id, url, html) as a record of archives under ``path``."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row, files = next(rows, None), 0
        while row is not None:
            name, n = f"{path}/part-{TaskContext.get().partitionId():06d}-{files:04d}.warc.gz", 0

            def write(out) -> None:
                nonlocal row, n
                size = 0
                while row is not None and size < roll:
                    page, url, html, of = row
                    data = member(record(page, url, (html or "").encode(), of, date))
                    out.write(data)
                    size += len(data)
                    n += 1
                    row = next(rows, None)

            write_file(name, write)
            files += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    again = common.materialise(revisits(pages, least).distinct(), "revisits").withColumnRenamed("page_id", "_page")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.join(again, (F.col("page_id") == F.col("_page")) & (F.sha1(html.cast("binary")) == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")
    rows.mapInArrow(store, "file string, records long").write.parquet(f"{path}/manifest")


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _number(urn: str | None) -> int | None:
    n = (urn or "").strip("<>").removeprefix(_URN)
    return int(n) if re.fullmatch(r"-?\d+", n) else None


def _digest(value: str | None) -> str | None:
    """A SHA-1 as bare lower-case hex, from hex or base32; other digests as they are."""
    kind, _, digest = (value or "").strip().rpartition(":")
    if kind.lower() in ("", "sha1") and re.fullmatch(r"[A-Z2-7a-z]{32}", digest):
        return base64.b32decode(digest.upper()).hex()
    return digest.lower() or None if kind.lower() in ("", "sha1") else value


def _length(h: dict) -> int | None:
    if "x-payload-length" in h:
        return int(h["x-payload-length"])
    http = h.get("content-type", "").startswith("application/http")
    return None if http or h.get("warc-type") == "revisit" else int(h["content-length"])


#: Columns that the WARC header alone gives.
FROM_HEADER: dict[str, Callable[[dict], object]] = {
    "record_type": lambda h: h.get("warc-type"),
    "record_id": lambda h: h.get("warc-record-id"),
    "page_id": lambda h: _number(h.get("warc-record-id")),
    "target_uri": lambda h: h.get("warc-target-uri"),
    "date": lambda h: h.get("warc-date"),
    "refers_to": lambda h: _number(h.get("warc-refers-to")),
    "payload_digest": lambda h: _digest(h.get("warc-payload-digest")),
    "payload_bytes": _length,
}
_TESTS: dict[type, Callable] = {
    EqualTo: lambda a, b: a is not None and a == b, In: lambda a, b: a is not None and a in b, GreaterThan: lambda a, b: a is not None and a > b, GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b, StringStartsWith: lambda a, b: a is not None and a.startswith(b), IsNotNull: lambda a, b: a is not None,
}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def plan(sizes: list[tuple[str, int]], target: int) -> list[list[str]]:
    """Files by partition: in order of name, together up to ``target`` bytes."""
    out: list[list[str]] = []
    held = 0
    for name, size in sorted(sizes):
        if not out or held + size > target:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.fieldNames(), options["path"]
        self.target = int(options.get("partitionbytes", 32 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, type, object]] = []
        self.inflated = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in FROM_HEADER:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = filesystem(self.path)
        found = files.get_file_info([at])[0]
        found = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        return [Files(names) for names in plan([(x.path, x.size) for x in found if x.path.endswith((".warc.gz", ".warc"))], self.target)] or [Files([])]

    def _row(self, h: dict, payload: bytes | None) -> tuple:
        if payload is not None and self.verify:
            digest, size = FROM_HEADER["payload_digest"](h), FROM_HEADER["payload_bytes"](h)
            if (digest and hashlib.sha1(payload).hexdigest() != digest) or (size is not None and len(payload) != size):
                raise ValueError(f"payload of {h.get('warc-record-id')} differs from its header")
        return tuple(payload if c == "payload" else FROM_HEADER[c](h) for c in self.columns)

    def _wanted(self, h: dict) -> tuple[bool, bool]:
        """Whether a record is a row, and whether its payload is needed for that."""
        row = all(_TESTS[kind](FROM_HEADER[name](h), value) for name, kind, value in self.tests)
        return row, row and h.get("warc-type") != "revisit" and (self.verify or "payload" in self.columns)

    def rows(self, source) -> Iterator[tuple]:
        """The wanted records of one archive (a file that can seek)."""
        start = source.read(_MEMBER.size)
        source.seek(0)
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl":
            yield from self._members(source)
        elif start[:2] == b"\x1f\x8b":
            yield from self._records(_Inflated(source))
        elif start:
            yield from self._records(_Plain(source))

    def _members(self, source) -> Iterator[tuple]:
        """Members with their lengths: only headers, and payloads that are needed, are inflated."""
        held = _Plain(source)
        while start := held.take(_MEMBER.size):
            if len(start) < _MEMBER.size:
                raise ValueError("an archive that ends within a record")
            *kind, size, _ = _MEMBER.unpack(start)
            if kind[:4] != [0x1F, 0x8B, 8, 4] or kind[8:10] != [ord("s"), ord("l")]:
                held.back(len(start))  # other members follow
                yield from self._records(_Inflated(held))
                return
            left = size - _MEMBER.size
            inflate, head, rest = zlib.decompressobj(-15), b"", b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                if not rest:
                    rest = held.take(min(HEAD, left))
                    left -= len(rest)
                    if not rest:
                        raise ValueError("a record without a header")
                head += inflate.decompress(rest, HEAD)
                rest = inflate.unconsumed_tail
            h = headers(head[:end])
            row, needed = self._wanted(h)
            payload = None
            if needed:
                data = rest + held.take(left)
                whole = head + inflate.decompress(data) + inflate.flush()
                if self.verify and zlib.crc32(whole) != struct.unpack("<I", inflate.unused_data[:4])[0]:
                    raise ValueError(f"damaged record {h.get('warc-record-id')}")
                payload = _payload(h, whole[end + 4 : end + 4 + int(h["content-length"])])
                self.inflated += 1
            else:
                held.skip(left)
            if row:
                yield self._row(h, payload)

    def _records(self, source) -> Iterator[tuple]:
        """Records one after the other in a stream of plain bytes."""
        while True:
            head = source.take(HEAD)
            head = head.lstrip(b"\r\n") if head.strip(b"\r\n") else b""
            if not head:
                return
            while (end := head.find(b"\r\n\r\n")) < 0:
                if not (more := source.take(HEAD)):
                    raise ValueError("a record without a header")
                head += more
            source.back(len(head) - end - 4)
            h = headers(head[:end])
            row, needed = self._wanted(h)
            size = int(h["content-length"])
            if needed:
                block = source.take(size)
                if len(block) < size:
                    raise ValueError(f"an archive that ends within record {h.get('warc-record-id')}")
                payload = _payload(h, block)
                self.inflated += 1
            else:
                payload = None
                source.skip(size)
            if row:
                yield self._row(h, payload)

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = filesystem(self.path)
        for name in partition.names:
            with files.open_input_file(name) as source:
                yield from self.rows(source)


def _payload(h: dict, block: bytes) -> bytes:
    """What a block holds: of an HTTP message the body, else all of it."""
    return block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block


class _Plain:
    """Bytes of a file, read ahead by CHUNK; what is skipped beyond that is not read."""

    def __init__(self, source):
        self.source, self.held, self.at = source, b"", 0

    def take(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            self.held = self.held[self.at :]
            self.at = 0
            parts = [self.held]
            need = n - len(self.held)
            while need > 0 and (more := self.more(max(CHUNK, need))):
                parts.append(more)
                need -= len(more)
            self.held = b"".join(parts)
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def more(self, n: int) -> bytes:
        return self.source.read(n)

    def read(self, n: int) -> bytes:
        return self.take(n)

    def back(self, n: int) -> None:
        """Puts back the last ``n`` bytes taken, all of which are still held."""
        self.at -= n
        if self.at < 0:
            raise ValueError("more put back than is held")

    def skip(self, n: int) -> None:
        inside = min(n, len(self.held) - self.at)
        self.at += inside
        if n > inside:
            self.source.seek(n - inside, 1)


class _Inflated(_Plain):
    """The bytes that a sequence of gzip members holds."""

    def __init__(self, source):
        super().__init__(source)
        self.inflate, self.raw = zlib.decompressobj(31), b""

    def more(self, n: int) -> bytes:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            if not self.raw and not (raw := self.source.read(CHUNK)):
                return b""
            out = self.inflate.decompress(self.raw or raw, n)
            self.raw = self.inflate.unconsumed_tail
            if out:
                return out

    def skip(self, n: int) -> None:
        while n > 0 and (part := self.take(min(n, CHUNK))):
            n -= len(part)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def op2_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write_warc(common.load(spark, sf_dir, "pages"), path)
    register(spark)
    read = spark.read.format("warc").schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
    return read.option("verify", "true").load(path).filter(F.col("record_type").isin("response", "revisit"))


QUERIES = {"op2_warc_source": op2_warc_source}
ORACLE_SQL = {
    "op2_warc_source": """
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as top from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < top then top end as refers_to, url as target_uri
from m"""
}
