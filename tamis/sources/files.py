"""Other inputs and outputs: Markdown records, locks, checkpoints, progress logs, exports."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "generated_at string, total_calls int, completed_calls int, total_disputed int, calls array<struct<uid: string, profile: string, ok: boolean, json_valid: boolean, reason: string, stderr: string>>"
LOCK = "total_included int, total_excluded int, records array<struct<uid: string, title: string, doi: string, pdf_path: string, sha256: string>>"


def csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; a byte-order mark in the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; broken files give one row with _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE")


def lock_records(locks: DataFrame) -> DataFrame:
    """One row per locked record, with its place."""
    return locks.select(F.posexplode("records").alias("place", "r")).select("place", "r.*")


def lock_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """A lock in YAML as one row (needs a YAML library; control characters are to be checked before)."""
    import yaml

    return spark.createDataFrame([json.dumps(yaml.safe_load(text))], "string").select(F.from_json("value", LOCK).alias("l")).select("l.*")


def binding_map(df: DataFrame, column: str) -> DataFrame:
    """JSON object key -> file name, as rows."""
    return df.select(F.explode(F.from_json(column, "map<string, string>")).alias("key", "file"))


def section(text: Column, name: str) -> Column:
    """The body of a Markdown section up to the next one."""
    return F.regexp_extract(text, rf"(?s)(?:^|\n)###? {name}\b[^\n]*\n(.*?)(?=\n###? |\n---|\z)", 1)


def quotes(section_text: Column, least: int = 35) -> Column:
    """Quoted lines of a section that are long enough to be verbatim evidence."""
    from tamis.functions import text as T

    lines = F.filter(F.split(section_text, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit(">")))
    bare = F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, r"^\s*>+", ""), F.lit(' "“”\t')))
    return F.filter(bare, lambda q: F.length(T.normalize(q)) >= least)


def markdown_records(spark: SparkSession, path: str) -> DataFrame:
    """Screening records: uid, decision (of the text, or else of the folder), sections and text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    said = F.regexp_extract("text", r"(?i)\*\*(?:decision|决策)\*\*\s*[:：]\s*(\w+)", 1)
    folder = F.element_at(F.split("path", "/"), -2)
    return raw.select(
        F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("uid"), F.when(said != "", said).otherwise(folder).alias("decision"),
        *[section(F.col("text"), d).alias(d) for d in "PICOS"], "text",
    )


def progress_log(lines: DataFrame) -> DataFrame:
    """Log lines ``[time] i/total uid profile state`` (column value); others become event raw_log."""
    part = lambda i: F.regexp_extract("value", r"^\[([^\]]+)\]\s+(\d+)/(\d+)\s+(\S+)\s+(\S+)\s+(.*)$", i)
    ok = part(1) != ""
    state = part(6)
    event = F.when(~ok, "raw_log").when(F.startswith(state, F.lit("reused_success")), "reused").when(F.startswith(state, F.lit("attempt=")), "attempt").otherwise("state")
    return lines.select(
        event.alias("event"), F.when(ok, F.try_to_timestamp(part(1))).alias("time"), F.when(ok, part(2).try_cast("int")).alias("index"), F.when(ok, part(3).try_cast("int")).alias("total"),
        F.when(ok, part(4)).alias("uid"), F.when(ok, part(5)).alias("profile"), F.when(ok, state).alias("state"), F.when(~ok, F.col("value")).alias("message"),
    )


def calls(checkpoints: DataFrame) -> DataFrame:
    """One row: calls, successes, failures (broken JSON counts as one), the last success and failure."""
    each = checkpoints.select("total_calls", F.posexplode_outer("calls").alias("pos", "c"))
    good = F.coalesce(F.col("c.ok") & F.col("c.json_valid"), F.lit(False))
    return each.agg(
        F.max("total_calls").alias("total_calls"), F.count_if(good).alias("n_ok"), F.count_if(F.col("c").isNotNull() & ~good).alias("n_failed"),
        F.max_by(F.when(good, F.col("c.uid")), F.when(good, F.col("pos"))).alias("last_ok"), F.max_by(F.when(~good, F.col("c.uid")), F.when(~good, F.col("pos"))).alias("last_failed"),
    )


# --- Fixed values: the columns of the export with their headings, and the words of a record ------
EXPORT = {
    "key": "Key", "author": "Author", "year": "Year", "title": "Title", "doi": "DOI", "decision": "最终决策", "code": "排除码", "reason": "判定理由", "at": "筛选日期",
    "p": "P判定", "i": "I判定", "device": "设备类型", "c": "C判定", "o": "O判定", "outcome": "结局类型", "s": "S判定", "design": "设计类型", "record": "MD文件",
}
DIMENSION_NAMES = {"P": "人群 (Population)", "I": "干预 (Intervention)", "C": "对照 (Comparator)", "O": "结局 (Outcomes)", "S": "研究设计 (Study Design)"}
RESULTS = {"PASS": "✅ 符合", "FAIL": "❌ 不符合", "UNCERTAIN": "⚠️ 不确定"}
# ------------------------------------------------------------------------------------------------


def result(section_text: Column) -> Column:
    """The verdict that a section of a record states; null if it states none."""
    words = F.create_map(*[F.lit(x) for verdict, words in RESULTS.items() for x in (words.split()[1], verdict)])
    return F.try_element_at(words, F.regexp_extract(section_text, r"\*\*判定\*\*：\S+ (\S+)", 1))


def export_columns(df: DataFrame, names: dict[str, str] = EXPORT) -> DataFrame:
    """The columns of ``names`` as strings under their headings; those that ``df`` lacks are null."""
    return df.select(*[(F.col(k).cast("string") if k in df.columns else F.lit(None).cast("string")).alias(v) for k, v in names.items()])


def export_csv(df: DataFrame, path: str, names: dict[str, str] = EXPORT) -> None:
    """CSV under other names, by default the 18 columns of the export, in order of the first, each file with a
    byte-order mark before its header, as spreadsheets want it."""
    out = export_columns(df, names)
    first = out.columns[0]
    out.orderBy(first).withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").csv(path, header=True, escape='"')


def markdown(records: DataFrame) -> DataFrame:
    """(uid, decision, text): a screening record as Markdown, that ``markdown_records`` reads. records: uid, decision,
    and as far as there are such columns title, author, year, doi, code, reason, and for each dimension p to s either
    its text or a struct of result, evidence (array of quotes) and a note. Nulls are empty, a missing code is 无."""
    have = dict(records.dtypes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    words = F.create_map(*[F.lit(x) for kv in RESULTS.items() for x in kv])

    def body(d: str) -> Column:
        name = d if d in have else d.lower()
        if name not in have:
            return F.lit("")
        if not have[name].startswith("struct"):
            return text(name)
        fields = records.schema[name].dataType.names
        quoted = F.array_join(F.transform(F.col(f"{name}.evidence"), lambda q: F.concat(F.lit('> "'), q, F.lit('"'))), "\n")
        said = F.coalesce(F.try_element_at(words, F.col(f"{name}.result")), F.lit(""))
        note = F.coalesce(F.col(f"{name}.note").cast("string"), F.lit("")) if "note" in fields else F.lit("")
        return F.concat(F.lit("\n**判定**："), said, F.lit("\n\n**原文证据**：\n\n"), F.coalesce(quoted, F.lit("")), F.when(note != "", F.concat(F.lit("\n\n"), note)).otherwise(""))

    about = [F.concat(F.lit(f"| **{label}** | "), text(c), F.lit(" |\n")) for c, label in (("title", "标题"), ("author", "作者"), ("year", "年份"), ("doi", "DOI")) if c in have]
    code = F.when(text("code") == "", "无").otherwise(text("code"))
    page = F.concat(
        F.lit("# "), F.col("uid"), F.lit("\n\n"), *([F.lit("| 字段 | 内容 |\n|------|------|\n"), *about, F.lit("\n---\n")] if about else []),
        *[F.concat(F.lit(f"\n### {d} — {name}\n"), body(d), F.lit("\n\n---\n")) for d, name in DIMENSION_NAMES.items()],
        F.lit("\n## 最终判定\n\n**决策**："), F.col("decision"), F.lit("\n\n**排除码**（如EXCLUDE）："), code, F.lit("\n\n**判定理由**：\n\n"), text("reason"), F.lit("\n"),
    )
    return records.select("uid", "decision", page.alias("text"))


def export_markdown(records: DataFrame, path: str, folders: tuple[str, ...] = ("decision",)) -> None:
    """Records as text in folders by decision, or by ("decision", "uid") for a file each."""
    markdown(records).select(*folders, F.col("text").alias("value")).write.partitionBy(*folders).mode("overwrite").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(value: dict, path: str) -> None:
    """One small local document: written aside and renamed."""
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False) as out:
        json.dump(value, out, ensure_ascii=False, indent=1)
    os.replace(out.name, path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(uid, text) of text files that are named by uid."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.select(F.url_decode(F.regexp_extract("path", r"([^/]+)\.txt$", 1)).alias("uid"), "text").filter("uid <> ''")


class PageText(Protocol):
    """Takes the text of the first pages (all, if none is given) from a document's bytes."""

    def pages(self, content: bytes, first: int | None) -> str: ...


def documents(spark: SparkSession, path: str, extractor: PageText, first: int | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """(path, sha256, size, text, problem) of binary documents by a pluggable extractor. A file above
    ``most_bytes``, or one on which the extractor fails, has a problem instead of a text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = raw.filter(F.col("length") > most_bytes).select("path", F.lit(None).cast("string").alias("sha256"), F.col("length").alias("size"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("problem"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for content in batch["content"]:
                try:
                    found.append((extractor.pages(bytes(content), first), None))
                except Exception as error:  # noqa: BLE001  a broken file is a row with its problem, not the end of the run
                    found.append((None, type(error).__name__))
            yield pd.DataFrame({"path": batch["path"], "sha256": batch["sha256"], "size": batch["size"], "text": [x for x, _ in found], "problem": [x for _, x in found]})

    small = raw.filter(F.col("length") <= most_bytes).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")
    return small.mapInPandas(run, "path string, sha256 string, size long, text string, problem string").unionByName(large)


def cached(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts known for the same key and digest: documents (key, sha256), cache (key, sha256, text)."""
    return documents.join(cache, ["key", "sha256"])


def backup(tables: dict[str, DataFrame], path: str, version: str) -> str:
    """Copies of tables under a folder for the version, which must be new."""
    where = f"{path}/{version}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{where}/{name}")
    return where
