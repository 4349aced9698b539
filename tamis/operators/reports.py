"""Reports: aggregates as rows (section, item, value), and their rendering from a bounded number of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators import gates, progress

SECTIONS = ["overview", "years", "exclusions", "dimensions", "attention", "skipped", "efficiency"]


def _rows(df: DataFrame, section: str, item: str | Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), (F.lit(item) if isinstance(item, str) else item).cast("string").alias("item"), value.cast("string").alias("value"))


def summary(papers: DataFrame, screening: DataFrame, most: int = 20) -> DataFrame:
    """The seven sections of a screening's report as (section, item, value). papers: key, title, year,
    path; screening: key, decision, code, at, and the dimensions p, i, c, o, s. most: of the lists of
    papers to look at, in order of key; counts are of all."""
    state = progress.progress(papers, screening, "key")
    overview = reduce(DataFrame.unionByName, [_rows(state, "overview", c, F.col(c)) for c in ("total", "processed", "remaining", "include_count", "exclude_count", "maybe_count", "skipped_count", "status")])
    both = papers.join(screening, "key")
    years = _rows(progress.count_by(both.filter("decision = 'INCLUDE' and year > 0"), "year"), "years", F.col("year"), F.col("n"))
    excluded = screening.filter("decision = 'EXCLUDE'")
    codes = _rows(progress.count_by(excluded.select(F.coalesce("code", F.lit("UNKNOWN")).alias("code")), "code"), "exclusions", F.col("code"), F.col("n"))
    dims = progress.dimension_stats(screening.filter("decision = 'INCLUDE'").select("p", "i", "c", "o", "s"), ["p", "i", "c", "o", "s"])
    dims = _rows(dims, "dimensions", F.concat_ws(" ", "dim", F.coalesce("result", F.lit("none"))), F.col("n"))
    lost = progress.missing_path(both)
    attention = _rows(lost.orderBy("key").limit(most), "attention", F.col("key"), F.lit("no document")).unionByName(_rows(lost.agg(F.count("*").alias("n")), "attention", "count", F.col("n")))
    skipped = both.filter("decision = 'SKIPPED'")
    skipped = _rows(skipped.orderBy("key").limit(most), "skipped", F.col("key"), F.col("title")).unionByName(_rows(skipped.agg(F.count("*").alias("n")), "skipped", "count", F.col("n")))
    left = papers.join(screening, "key", "left_anti")
    speed = progress.efficiency(screening.select("at"), left)
    speed = reduce(DataFrame.unionByName, [_rows(speed, "efficiency", c, F.col(c)) for c in ("processed", "days", "remaining")])
    return reduce(DataFrame.unionByName, [overview, years, codes, dims, attention, skipped, speed])


def gate_report(issues: DataFrame, most: int = 100) -> DataFrame:
    """A gate's verdict and counts, and its first issues by severity: (section, item, value)."""
    state = gates.gate(issues)
    head = reduce(DataFrame.unionByName, [_rows(state, "gate", c, F.col(c)) for c in ("passed", "fail", "warn", "info")])
    rank = F.when(F.col("severity") == "FAIL", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    first = issues.orderBy(rank, "scope", "uid", "message", "evidence").limit(most)
    return head.unionByName(_rows(first, "issues", F.concat_ws(" ", "severity", "scope", F.col("uid")), F.concat_ws(": ", "message", F.col("evidence"))))


def audit_report(findings: DataFrame, audited: DataFrame, most: int = 100) -> DataFrame:
    """Counts by severity over the audited records, and the first findings: (section, item, value)."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("HIGH", "MEDIUM", "LOW")]).crossJoin(audited.agg(F.count("*").alias("audited")))
    head = reduce(DataFrame.unionByName, [_rows(n, "audit", c, F.col(c)) for c in ("audited", "HIGH", "MEDIUM", "LOW")])
    first = gates.by_severity(findings).limit(most)
    return head.unionByName(_rows(first, "findings", F.concat_ws(" ", "severity", F.col("uid").cast("string"), "category"), F.col("evidence")))


def validation_report(confusion: DataFrame) -> DataFrame:
    """(label, n) of a pre-screen's check, with its accuracy among what the rules excluded: (section, item, value)."""
    of = lambda x: F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0))
    accuracy = confusion.agg(of("confirmed_exclude").alias("a"), of("false_positive").alias("b"))
    return _rows(confusion, "labels", F.col("label"), F.col("n")).unionByName(_rows(accuracy, "accuracy", "rules", F.bround(F.try_divide("a", F.col("a") + F.col("b")), 4)))


def render(report: DataFrame, title: str, sections: list[str], most: int = 2000) -> str:
    """Markdown of a report, a table for each section. Its rows are bounded by the report's own lists; more than ``most`` raise."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [f"# {title}", ""]
    for number, section in enumerate(sections, 1):
        lines += [f"## {number}. {section}", "", "| item | value |", "|---|---|"]
        cell = lambda x: ("" if x is None else x).replace("|", "\\|").replace("\n", " ")
        lines += [f"| {cell(r.item)} | {cell(r.value)} |" for r in sorted((r for r in rows if r.section == section), key=lambda r: (r.item or "", r.value or ""))] + [""]
    return "\n".join(lines)
