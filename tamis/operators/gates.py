"""Issues as rows: (severity, scope, uid, message, evidence). Gates are unions of such rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import rules
from tamis.functions import text as T
from tamis.operators import terms


def issue(df: DataFrame, when: Column, severity: str | Column, scope: str, uid: str, message: str, evidence: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.filter(when).select(sev.alias("severity"), F.lit(scope).alias("scope"), F.col(uid).cast("string").alias("uid"), F.lit(message).alias("message"), evidence.cast("string").alias("evidence"))


def union(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def gate(issues: DataFrame) -> DataFrame:
    """One row: counts by severity, and whether there is no FAIL."""
    n = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("FAIL", "WARN", "INFO")]
    return issues.agg(*n).withColumn("passed", F.col("fail") == 0)


def shared_hash(df: DataFrame, uid: str, digest: str, *meta: str) -> DataFrame:
    """A row for each record whose digest others have: uid, digest, n, first_uid (the class), how many
    values each of the ``meta`` columns has in it, and severity: FAIL if one differs, else INFO.
    Classes are not gathered into one row, so one of any size is no burden to a task."""
    out = df.groupBy(digest).agg(F.count("*").alias("n"), F.min(uid).alias("first_uid"), *[F.countDistinct(m).alias(f"n_{m}") for m in meta]).filter("n > 1")
    differs = reduce(lambda a, b: a | b, [F.col(f"n_{m}") > 1 for m in meta])
    return df.select(uid, digest).join(out.withColumn("severity", F.when(differs, "FAIL").otherwise("INFO")), digest)


def lock_issues(lock: DataFrame, assets: DataFrame) -> DataFrame:
    """Checks of a lock (uid, title, sha256) against assets (uid, title, sha256)."""
    repeats = lock.groupBy("uid").agg(F.count("*").alias("n"))
    found = lock.join(assets.select("uid", F.col("title").alias("asset_title"), F.col("sha256").alias("asset_sha")), "uid", "left")
    share = T.overlap(T.title_tokens(F.col("title")), T.normalize(F.col("asset_title")))
    return union(
        issue(lock, F.col("uid").isNull(), "FAIL", "lock", "uid", "uid missing", F.lit("")),
        issue(repeats, F.col("n") > 1, "FAIL", "lock", "uid", "uid repeated", F.col("n")),
        issue(lock, F.size(T.control_characters(F.col("title"))) > 0, "FAIL", "lock", "uid", "control characters", F.array_join(T.control_characters(F.col("title")), ",")),
        issue(found, F.col("asset_sha").isNull(), "FAIL", "asset", "uid", "asset missing", F.lit("")),
        issue(found, F.col("asset_sha") != F.col("sha256"), "FAIL", "asset", "uid", "sha256 differs", F.left("asset_sha", F.lit(12))),
        issue(found, F.col("asset_title").isNotNull() & (share < 0.35), "WARN", "asset", "uid", "title overlap low", F.size(T.title_tokens(F.col("title")))),
    )


def lock_vs_database(lock: DataFrame, database: DataFrame, excluded: DataFrame) -> DataFrame:
    """lock (uid), database (uid, decision), excluded (uid: by an administrator). A uid of the lock that the database lacks raises nothing."""
    both = lock.select("uid", F.lit(True).alias("locked")).join(database, "uid", "full").join(excluded.select("uid", F.lit(True).alias("barred")), "uid", "left")
    return union(
        issue(both, F.col("locked") & (F.col("decision") != "INCLUDE"), "WARN", "database", "uid", "locked but not included", F.col("decision")),
        issue(both, F.col("locked").isNull() & (F.col("decision") == "INCLUDE") & F.col("barred").isNull(), "WARN", "database", "uid", "included but not locked", F.col("decision")),
        issue(both, F.col("locked").isNull() & (F.col("decision") == "INCLUDE") & F.col("barred"), "FAIL", "database", "uid", "included but excluded by administrator", F.col("decision")),
    )


def audit_findings(records: DataFrame, uid: str, sections: dict[str, Column], audit_rules: list = rules.AUDIT_RULES) -> DataFrame:
    """(severity, uid, category, evidence) of each rule that hits some terms and lacks others."""
    # Normalized once, before the rules, each of which would else do it anew.
    records = records.select(F.col(uid).alias("uid"), *[T.normalize(F.coalesce(v, F.lit(""))).alias(f"_{k}") for k, v in sections.items()])
    normal = {k: F.col(f"_{k}") for k in sections}
    found = []
    for severity, category, where, hit, other, lacks, least in audit_rules:
        hits = T.contains_any(F.concat_ws(" ", *[normal[s] for s in where]), hit)
        ok = (F.size(hits) > 0) & (F.size(T.contains_any(normal[other], lacks)) < least)
        found.append(F.when(ok, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.array_join(F.slice(hits, 1, 8), ", ").alias("evidence"))))
    return records.select("uid", F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.severity", "uid", "f.category", "f.evidence")


def grounding_findings(ungrounded: DataFrame) -> DataFrame:
    """ungrounded (uid, n): HIGH from two quotes on, MEDIUM for one."""
    return ungrounded.filter("n > 0").select(F.when(F.col("n") >= 2, "HIGH").otherwise("MEDIUM").alias("severity"), "uid", F.lit("evidence_not_found").alias("category"), "n")


def by_severity(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).when(F.col("severity") == "LOW", 2).otherwise(3)
    return findings.orderBy(rank, "uid", "category")


def absent_artifacts(lock: DataFrame, texts: DataFrame, records: DataFrame) -> DataFrame:
    """(severity, uid, category, evidence) of locked uids without a text (HIGH) or without a record (MEDIUM).
    An empty text is none."""
    out = lock.select("uid").distinct().join(texts.filter("text <> ''").select("uid", F.lit(True).alias("has_text")).distinct(), "uid", "left").join(records.select("uid", F.lit(True).alias("has_record")).distinct(), "uid", "left")
    found = F.array_compact(F.array(F.when(F.col("has_text").isNull(), F.struct(F.lit("HIGH").alias("severity"), F.lit("missing_txt").alias("category"))), F.when(F.col("has_record").isNull(), F.struct(F.lit("MEDIUM").alias("severity"), F.lit("missing_record").alias("category")))))
    return out.select("uid", F.explode(found).alias("f")).select("f.severity", "uid", "f.category", F.lit("").alias("evidence"))


def record_audit(lock: DataFrame, texts: DataFrame, records: DataFrame, sections: dict[str, Column], audit_rules: list = rules.AUDIT_RULES) -> DataFrame:
    """(severity, uid, category, evidence): all findings on the locked uids (uid) by their texts (uid, text) and
    records (uid and what ``sections`` are made of). A uid without a record has no findings beyond that."""
    held = records.join(lock.select("uid").distinct(), "uid", "left_semi")
    return audit_findings(held, "uid", sections, audit_rules).unionByName(absent_artifacts(lock, texts, records.select("uid")))


def rule_audit(records: DataFrame) -> DataFrame:
    """(key, decision, risk_categories, context): records (key, decision, c, o, reason) of which a
    decision and the words of its reasons disagree; categories joined by ``;``."""
    c, o, reason = (F.coalesce(x, F.lit("")) for x in ("c", "o", "reason"))
    has = lambda text, terms: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t.lower())) for t in terms])
    rows = records.withColumn("_c", F.lower(F.concat(c, reason))).withColumn("_o", F.lower(F.concat(o, reason))).withColumn("_r", F.lower(reason))
    include, exclude = F.col("decision") == "INCLUDE", F.col("decision") == "EXCLUDE"
    tests = [include & has(F.col("_c"), rules.RISK_INTERNAL), exclude & has(F.col("_o"), rules.RISK_TRANSFER), include & has(F.col("_o"), rules.RISK_KNOWLEDGE), has(F.col("_r"), rules.RISK_CONTRADICTION)]
    found = F.array_compact(F.array(*[F.when(test, name) for test, name in zip(tests, rules.RISK_CATEGORIES)]))
    context = F.left(F.trim(F.regexp_replace(F.concat_ws(" ", c, o, reason), r"\s+", " ")), F.lit(500))
    return rows.select("key", "decision", F.array_join(found, ";").alias("risk_categories"), context.alias("context")).filter("risk_categories <> ''")


def lock_contents(lock: DataFrame, files: DataFrame, least: float = 0.35, blank: bool = False) -> DataFrame:
    """Issues of a lock (uid, title, doi, path, sha256) against files (path, sha256, first_text): no uid, no
    path, no such file, other digest, DOI or title not on the first pages. First pages without a
    letter or digit count as unreadable and are not judged; with ``blank`` nothing is found on them (of pages that
    are null only the title is judged)."""
    from tamis.operators import binding

    named = lock.filter(F.coalesce("uid", F.lit("")) != "")
    held = named.join(files.select("path", F.col("sha256").alias("actual"), "first_text", F.lit(True).alias("there")), "path", "left")
    no_path = F.coalesce("path", F.lit("")) == ""
    there = held.filter("there").withColumn("tk", T.title_tokens(F.coalesce("title", F.lit("")))).withColumn("norm", T.normalize(F.coalesce("first_text", F.lit("")))).withColumn("d", T.normalize_doi(F.coalesce("doi", F.lit(""))))
    shown = lambda c: F.lit(True) if blank else c != ""
    return union(
        issue(lock, F.coalesce("uid", F.lit("")) == "", "FAIL", "lock", "uid", "uid missing", F.lit("")), issue(named, no_path, "FAIL", "lock", "uid", "path missing", F.lit("")),
        issue(held, ~no_path & F.col("there").isNull(), "FAIL", "file", "uid", "file missing", F.col("path")),
        issue(held, F.col("there") & (F.lower("sha256") != F.col("actual")) & (F.col("sha256") != ""), "FAIL", "file", "uid", "sha256 differs", F.col("actual")),
        issue(there, (F.col("d") != "") & F.col("first_text").isNotNull() & shown(F.col("first_text")) & ~binding.doi_found(F.col("d"), F.col("first_text")), "WARN", "file", "uid", "doi not found", F.col("d")),
        issue(there, (F.size("tk") > 0) & shown(F.col("norm")) & (T.overlap(F.col("tk"), F.col("norm")) < least), "WARN", "file", "uid", "title overlap low", F.size("tk")),
    )


def lock_counts(locks: DataFrame, expected_included: int | None = None, expected_excluded: int | None = None, strict: bool = False) -> DataFrame:
    """Issues of the counts of locks (scope, total_included, total_excluded, n_records) against what is
    expected, if given; with ``strict`` also of total_included against the records."""
    tests = [("FAIL", "total_included unexpected", "total_included", expected_included), ("FAIL", "records unexpected", "n_records", expected_included), ("WARN", "total_excluded unexpected", "total_excluded", expected_excluded)]
    out = [issue(locks.withColumn("uid", F.lit("")), ~F.col(c).eqNullSafe(F.lit(n)), s, "lock", "uid", m, F.col(c)) for s, m, c, n in tests if n is not None]
    if strict:
        out.append(issue(locks.withColumn("uid", F.lit("")), ~F.col("total_included").eqNullSafe(F.col("n_records")), "FAIL", "lock", "uid", "records differ from total_included", F.col("n_records")))
    return union(*out) if out else issue(locks.withColumn("uid", F.lit("")), F.lit(False), "FAIL", "lock", "uid", "", F.lit(""))


def admin_lists(lock: DataFrame, included: DataFrame, excluded: DataFrame) -> DataFrame:
    """Issues of the administrator's lists (uid): included but not locked, excluded but still locked."""
    return union(
        issue(included.join(lock, "uid", "left_anti"), F.lit(True), "FAIL", "lock", "uid", "included by administrator, not locked", F.lit("")),
        issue(excluded.join(lock, "uid", "left_semi"), F.lit(True), "FAIL", "lock", "uid", "excluded by administrator, still locked", F.lit("")),
    )


def downstream(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Issues of excluded uids (a table, uid) that occur in files (path, text): in the text of tables, or
    in the names of JSON files outside of folders set aside. All uids are looked for at once."""
    name = F.element_at(F.split("path", "/"), -1)
    aside = F.contains("path", F.lit("_excluded")) | F.contains(F.lower("path"), F.lit("quarantine"))
    where = F.when(F.endswith("path", F.lit(".tsv")), F.coalesce("text", F.lit(""))).when(F.endswith("path", F.lit(".json")) & ~aside, name).otherwise("")
    hits = terms.found_terms(files.select(F.col("path").alias("key"), where.alias("text")), excluded.select(F.col("uid").alias("term_id"), F.col("uid").alias("term"))).select(F.col("key").alias("path"), F.col("term_id").alias("uid"))
    return issue(hits, F.lit(True), "FAIL", "downstream", "uid", "excluded uid downstream", F.col("path"))


def database_guard(tables: list[str], required: list[str], papers: DataFrame, screening: DataFrame) -> DataFrame:
    """(check, ok, evidence) before a database is written: all tables there, papers not empty, and no
    more decisions than papers."""
    n = papers.agg(F.count("*").alias("p")).crossJoin(screening.agg(F.count("*").alias("s")))
    missing = ",".join(sorted(set(required) - set(tables)))
    checks = F.array(F.struct(F.lit("tables").alias("check"), F.lit(missing == "").alias("ok"), F.lit(missing).alias("evidence")), F.struct(F.lit("papers").alias("check"), (F.col("p") > 0).alias("ok"), F.col("p").cast("string").alias("evidence")), F.struct(F.lit("screening").alias("check"), (F.col("s") <= F.col("p")).alias("ok"), F.col("s").cast("string").alias("evidence")))
    return n.select(F.explode(checks).alias("c")).select("c.*")
