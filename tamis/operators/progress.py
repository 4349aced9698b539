"""Derived progress, work queues, distributions and consistency of a screening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def progress(papers: DataFrame, screening: DataFrame, key: str, stored_status: str = "running") -> DataFrame:
    """One row: total, processed, remaining, a count per decision, and the status they imply."""
    counts = screening.agg(F.count("*").alias("processed"), *[F.count_if(F.col("decision") == d).alias(f"{d.lower()}_count") for d in ("INCLUDE", "EXCLUDE", "MAYBE", "SKIPPED", "ERROR")])
    left = papers.join(screening, key, "left_anti").agg(F.count("*").alias("remaining"))
    out = papers.agg(F.count("*").alias("total")).crossJoin(counts).crossJoin(left)
    status = F.when(F.col("total") == 0, "idle").when(F.col("remaining") == 0, "done").when(F.lit(stored_status) == "done", "running").otherwise(stored_status)
    return out.withColumn("status", status)


def work_queue(papers: DataFrame, screening: DataFrame, key: str, valid: Column, n: int = 20) -> DataFrame:
    """The next ``n`` valid papers without a decision, in order of key (a top-k, not a sort of all)."""
    return papers.filter(valid).join(screening, key, "left_anti").orderBy(key).limit(n)


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def exclusion_distribution(excluded: DataFrame, code: str, reason: str) -> DataFrame:
    """By raw code (null and '' apart): label, count and the distinct reasons in order."""
    label = F.coalesce(F.col(code), F.lit("UNKNOWN"))
    reasons = F.concat_ws(",", F.array_sort(F.collect_set(reason)))
    return excluded.groupBy(code).agg(F.count("*").alias("cnt"), reasons.alias("reasons")).select(F.col(code).alias("code"), label.alias("label"), "cnt", "reasons")


def dimension_stats(judged: DataFrame, dimensions: list[str]) -> DataFrame:
    """One pass over all dimensions: (dim, result, n, pass_rate)."""
    long = judged.unpivot([], dimensions, "dim", "result").groupBy("dim", "result").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dim")
    return long.withColumn("pass_rate", F.sum(F.when(F.col("result") == "PASS", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """By group: rows, least, greatest and the element at n // 2 in order. Values are counted before
    the exchange, so a window ranks distinct values, not rows."""
    counts = df.groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("_v"))).withColumn("_all", F.sum("_n").over(w))
    picked = F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1, F.col("_v")))
    return ranked.groupBy(by).agg(F.sum("_n").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), picked.alias("upper_median"))


def consistency(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check, expected, actual, ok) from one-row, one-column DataFrames."""
    rows = [e.toDF("expected").crossJoin(a.toDF("actual")).select(F.lit(name).alias("check"), "expected", "actual") for name, e, a in checks]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("expected") == F.col("actual"))


CACHED = ["total", "processed", "remaining", "include_count", "exclude_count", "maybe_count", "skipped_count", "error_count"]


def verify(stored: DataFrame, papers: DataFrame, screening: DataFrame, key: str, files: DataFrame | None = None) -> DataFrame:
    """(check, subject, expected, actual) of all that is wrong; no rows mean that all holds. cache: a field of the
    stored progress (one row; missing or null fields are 0) that differs from what the tables imply; conservation:
    processed and remaining don't add up to the total (orphans, repeated keys); file: the path of a
    screening record (columns key and path; null: none was written) that is not among files (path)."""
    real = progress(papers, screening, key)
    long = lambda df, value: df.agg(*[F.coalesce(F.max(f) if f in df.columns else F.lit(None), F.lit(0)).cast("long").alias(f) for f in CACHED]).unpivot([], CACHED, "subject", value)
    both = long(stored, "actual").join(long(real, "expected"), "subject").filter("actual <> expected")
    out = both.select(F.lit("cache").alias("check"), "subject", F.col("expected").cast("string").alias("expected"), F.col("actual").cast("string").alias("actual"))
    kept = real.filter("processed + remaining <> total").select(F.lit("conservation"), F.lit("processed + remaining"), F.col("total").cast("string"), F.expr("processed + remaining").cast("string"))
    out = out.union(kept)
    if files is not None:
        gone = screening.filter("path is not null").join(files.select("path"), "path", "left_anti")
        out = out.union(gone.select(F.lit("file"), F.col(key).cast("string"), "path", F.lit(None).cast("string")))
    return out


def last_wins(old: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key; of rows of ``new`` with one
    key the last by ``position`` (dropped from the result unless ``old`` has it) counts."""
    one = Window.partitionBy(key).orderBy(F.desc(position))
    last = new.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*old.columns)
    return last.unionByName(old.join(new, key, "left_anti"))


def first_wins(old: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of ``new`` with keys that are not in ``old``; within ``new`` the first by ``position``."""
    one = Window.partitionBy(key).orderBy(position)
    return new.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n").join(old, key, "left_anti")


def reconcile(completed: DataFrame, files: DataFrame) -> DataFrame:
    """(key, status, decision): state (key) against record files (key, decision). missing: marked as
    done without a file, to be done again; unmarked: a file that the state lacks, to be marked with the
    file's decision; ok. Several files of a key are one, with the first decision by name."""
    one = files.groupBy("key").agg(F.min("decision").alias("decision"))
    both = completed.select("key").distinct().withColumn("done", F.lit(True)).join(one, "key", "full")
    status = F.when(F.col("done").isNull(), "unmarked").when(F.col("decision").isNull(), "missing").otherwise("ok")
    return both.select("key", status.alias("status"), "decision")


def recount(expected: DataFrame, files: DataFrame, decisions: list[str]) -> DataFrame:
    """(decision, expected, actual, ok): stored counts (decision, n) against record files, for each of ``decisions``."""
    every = files.sparkSession.createDataFrame([(d,) for d in decisions], "decision string")
    actual = files.groupBy("decision").agg(F.count("*").alias("actual"))
    out = every.join(expected.select("decision", F.col("n").alias("expected")), "decision", "left").join(actual, "decision", "left").fillna(0, ["expected", "actual"])
    return out.withColumn("ok", F.col("expected") == F.col("actual"))


def efficiency(processed: DataFrame, remaining: DataFrame) -> DataFrame:
    """One row: processed, days, daily_average, remaining, eta_days. processed: at (a time), one row each; remaining: one row each."""
    done = processed.agg(F.count("*").alias("processed"), F.countDistinct(F.to_date("at")).alias("days"))
    out = done.crossJoin(remaining.agg(F.count("*").alias("remaining"))).withColumn("daily_average", F.try_divide("processed", "days"))
    return out.withColumn("eta_days", F.when((F.col("remaining") > 0) & (F.col("daily_average") > 0), F.col("remaining") / F.col("daily_average")))


def qa_status(reviews: DataFrame, screening: DataFrame, key: str) -> DataFrame:
    """One row: resolved, confirmed and pending_maybe. reviews: key, action (resolve or confirm); a MAYBE
    without a resolution is pending. Repeated reviews of a key and action count once."""
    counts = reviews.select(key, "action").distinct().agg(F.count_if(F.col("action") == "resolve").alias("resolved"), F.count_if(F.col("action") == "confirm").alias("confirmed"))
    resolved = reviews.filter("action = 'resolve'").select(key).distinct()
    pending = screening.filter("decision = 'MAYBE'").join(resolved, key, "left_anti").agg(F.count("*").alias("pending_maybe"))
    return counts.crossJoin(pending)


def find(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, if there is one: a filter that reaches the scan."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def missing_path(included: DataFrame, path: str = "path") -> DataFrame:
    """Included records whose path is null or empty."""
    return included.filter((F.col("decision") == "INCLUDE") & (F.col(path).isNull() | (F.col(path) == "")))


def invalid_paper() -> Column:
    """No author, year 0 and no title; null where one of them is null and the others don't decide."""
    return (F.col("author") == "") & (F.col("year") == 0) & (F.col("title") == "")


def latest_reviews(reviews: DataFrame, *by: str) -> DataFrame:
    """The last review by reviewed_at of each key and action."""
    w = Window.partitionBy(*by).orderBy(F.desc("reviewed_at"), *[F.desc(c) for c in reviews.columns if c not in by and c != "reviewed_at"])
    return reviews.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
