"""Bibliographic RIS files: a parser as columns over whole records, without a line-by-line state machine.

A file is cut at its end-of-record lines, by Spark's text source with that line's start as separator;
a record's lines are split again before each tag line (continuation lines join the field before), all
by functions on arrays within the record's row. Repeated scalar tags concatenate with a blank; authors and keywords are
lists. A record without a title is dropped. An end-of-record line needs its trailing blank, as in
the format; without it two records merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import text as T

# --- Fixed values: tags of the format ----------------------------------------------------------
FIELDS = {
    "TY": "type", "TI": "title", "T1": "title", "AU": "authors", "A1": "authors", "PY": "year", "Y1": "year", "DA": "date", "AB": "abstract", "N2": "abstract", "DO": "doi", "UR": "url", "KW": "keywords",
    "JO": "journal", "JF": "journal", "T2": "journal", "VL": "volume", "IS": "issue", "SP": "start_page", "EP": "end_page", "SN": "issn", "LA": "language", "AN": "accession_number",
}
LISTS = ["authors", "keywords"]
END = "\nER  - "
# ------------------------------------------------------------------------------------------------
SCALARS = [f for f in dict.fromkeys(FIELDS.values()) if f not in LISTS]


def key(authors: Column, year: Column, title: Column) -> Column:
    """Last name and initial of the first author (ASCII letters only), year, and six digits of the title's md5."""
    parts = F.split(F.get(authors, 0), ",")
    last = F.trim(F.regexp_replace(F.trim(F.get(parts, 0)), r"[^a-zA-Z\s-]", ""))
    initial = F.left(F.trim(F.coalesce(F.get(parts, 1), F.lit(""))), F.lit(1))
    return F.concat(F.coalesce(F.concat(last, initial), F.lit("")), F.lit("_"), year.cast("string"), F.lit("_"), T.md5_prefix(title, 6))


#: A line that starts a field: tag, two blanks, a dash, a blank.
TAG_LINE = r"^[A-Z][A-Z0-9][^\S\n]{2}-[^\S\n]"


def _fields(body: Column) -> Column:
    """The fields (tag, value) of one record's lines, in order. Lines that are no tag line and no
    continuation are dropped, as are continuations before the first tag line."""
    lines = F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & (F.rlike(x, F.lit(TAG_LINE)) | F.rlike(x, F.lit(r"^(  |\t)"))))
    fields = F.filter(F.split(F.array_join(lines, "\n"), rf"(?m)(?={TAG_LINE})"), lambda x: F.rlike(x, F.lit(TAG_LINE)))
    bare = lambda x: F.btrim(x, F.lit(" \t"))
    value = lambda x: F.array_join(F.filter(F.transform(F.split(F.substr(x, F.lit(7)), "\n"), bare), lambda y: y != ""), " ")
    return F.filter(F.transform(fields, lambda x: F.struct(F.left(x, F.lit(2)).alias("tag"), value(x).alias("value"))), lambda f: f["value"] != "")


def parse(files: DataFrame) -> DataFrame:
    """files (content, and any columns that tell them apart, such as path): one row per record with a
    title, with those columns, record (its position in the content) and the fields. Nothing is
    exchanged: a record's lines are taken apart within its row, so it serves streams as well."""
    of = [c for c in files.columns if c != "content"]
    content = F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), r"\r\n?", "\n")
    records = files.select(*of, F.posexplode(F.split(content, r"(?m)^ER  - [^\n]*$")).alias("record", "body"))
    fields = records.select(*of, "record", _fields(F.col("body")).alias("_f"))
    values = lambda name: F.transform(F.filter("_f", lambda f: f["tag"].isin([k for k, v in FIELDS.items() if v == name])), lambda f: f["value"])
    per = fields.select(*of, "record", *[values(f).alias(f) for f in [*SCALARS, *LISTS]])
    out = per.select(*of, "record", *[F.when(F.size(f) > 0, F.array_join(f, " ")).alias(f) for f in SCALARS], *LISTS).filter("title is not null")
    out = out.withColumn("year", T.year(F.coalesce("year", F.lit("")))).withColumn("authors_str", F.array_join("authors", "; "))
    return out.withColumn("key", key(F.col("authors"), F.col("year"), F.col("title")))


def _pieces(raw: DataFrame, *row: Column) -> DataFrame:
    meta = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), *row, F.col("value").alias("content"))
    return meta.filter(F.trim("content") != "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files under ``path``. Files are cut at their end-of-record lines by the text source
    itself, at byte ranges of ``spark.sql.files.maxPartitionBytes``, so one large file is many tasks
    and no string holds more than a record. (path, block, row, record) orders records as in the files:
    block is the byte range's start, row grows within it. What an end-of-record line holds after its
    dash is ignored unless it looks like a field. A file with bare carriage returns isn't cut."""
    return parse(_pieces(spark.read.option("lineSep", END).text(path), F.monotonically_increasing_id().alias("row")))


def read_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Records of files as they arrive under ``path``, a few at a time. Streams number no rows, so there is no column row."""
    return parse(_pieces(spark.readStream.option("lineSep", END).option("maxFilesPerTrigger", files).text(path)))


def new_records(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records of ``read`` whose key is not in ``known``; of those with one key the first in the files."""
    place = F.struct("path", "block", "row", "record")
    first = records.groupBy("key").agg(F.min_by(F.struct(*[c for c in records.columns if c != "key"]), place).alias("r"))
    return first.join(known.select("key").distinct(), "key", "left_anti").select("key", "r.*").select(*records.columns)


def stats(records: DataFrame) -> DataFrame:
    """Totals, fields present, and years (0 left out) with their upper median."""
    years = records.filter("year > 0").select(F.lit(1).alias("one"), "year")
    w = Window.partitionBy("one").orderBy("year")
    median = years.groupBy("one", "year").agg(F.count("*").alias("n"))
    median = median.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("one"))).filter("upto >= all div 2 + 1").agg(F.min("year").alias("median_year"))
    return records.agg(F.count("*").alias("total"), F.count("abstract").alias("has_abstract"), F.count("doi").alias("has_doi"), F.min(F.when(F.col("year") > 0, F.col("year"))).alias("least_year"), F.max("year").alias("most_year")).crossJoin(median)
