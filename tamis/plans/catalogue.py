"""All queries of the screening engine over the given tables, with their DuckDB SQL.

Roles: documents are papers with full text, labels their decisions (none: still to screen), benchmark
the quotes, pages the bound assets, events the run log, conversations the transcripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.operators import decisions, gates, limiter, matching, progress, runs, terms

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, t) under its name; ``t(name)`` gives a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("@S", SCREENING_SQL).replace("@D", DIMENSIONS_SQL)
        return f

    return add


SCREENING_SQL = "s as (select doc_id, case when toxic = 1 then 'EXCLUDE' when quality = 1 then 'INCLUDE' else 'MAYBE' end as decision from labels)"
DIMENSIONS_SQL = r"""j as (select doc_id, text, lang, n_chars, split_part(text, chr(10), 1) as title,
 case when lang = 'en' then 'PASS' when lang = 'es' then 'FAIL' else 'UNCERTAIN' end as p,
 case when n_chars >= 500 then 'PASS' when n_chars < 100 then 'FAIL' else 'UNCERTAIN' end as i,
 case when contains(lower(text), 'licensed under') then 'FAIL' else 'PASS' end as c,
 case when contains(text, '@') then 'FAIL' else 'PASS' end as o,
 case when contains(text, ' | ') then 'FAIL' else 'PASS' end as s from documents)"""


def screening(t) -> DataFrame:
    decision = F.when(F.col("toxic") == 1, "EXCLUDE").when(F.col("quality") == 1, "INCLUDE").otherwise("MAYBE")
    return t("labels").select("doc_id", decision.alias("decision"))


def judged(t) -> DataFrame:
    """Five dimensions derived from language, length, license lines, mail addresses and table rows."""
    return t("documents").select(
        "doc_id", "text", "lang", "n_chars", T.title(F.col("text")).alias("title"),
        F.when(F.col("lang") == "en", "PASS").when(F.col("lang") == "es", "FAIL").otherwise("UNCERTAIN").alias("p"),
        F.when(F.col("n_chars") >= 500, "PASS").when(F.col("n_chars") < 100, "FAIL").otherwise("UNCERTAIN").alias("i"),
        F.when(F.contains(F.lower("text"), F.lit("licensed under")), "FAIL").otherwise("PASS").alias("c"),
        F.when(F.contains("text", F.lit("@")), "FAIL").otherwise("PASS").alias("o"),
        F.when(F.contains("text", F.lit(" | ")), "FAIL").otherwise("PASS").alias("s"),
    )


def events(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("run"), "event_id", "ts", F.col("event_type").alias("state"), F.col("value").alias("tokens"), "props")


@query("""with @S select count(*) as total, (select count(*) from s) as processed, (select count(*) from s where decision = 'INCLUDE') as include_count,
 (select count(*) from s where decision = 'EXCLUDE') as exclude_count, (select count(*) from s where decision = 'MAYBE') as maybe_count, cast(0 as bigint) as skipped_count, cast(0 as bigint) as error_count,
 count(*) filter (where doc_id not in (select doc_id from s)) as remaining, case when count(*) = 0 then 'idle' when count(*) filter (where doc_id not in (select doc_id from s)) = 0 then 'done' else 'running' end as status from documents""")
def q_progress(spark, t):
    return progress.progress(t("documents"), screening(t), "doc_id")


@query("with @S select decision, count(*) as n from s group by 1")
def q_decision_counts(spark, t):
    return progress.count_by(screening(t), "decision")


@query("select doc_id, split_part(text, chr(10), 1) as title from documents where not n_chars < 20 and doc_id not in (select doc_id from labels) order by doc_id limit 20")
def q_work_queue(spark, t):
    return progress.work_queue(t("documents"), screening(t), "doc_id", ~(F.col("n_chars") < 20)).select("doc_id", T.title(F.col("text")).alias("title"))


@query("select doc_id, n_chars from documents where n_chars < 60 and doc_id not in (select doc_id from labels)")
def q_invalid_records(spark, t):
    return t("documents").filter(F.col("n_chars") < 60).join(screening(t), "doc_id", "left_anti").select("doc_id", "n_chars")


@query("with @S select doc_id, split_part(text, chr(10), 1) as title from documents join s using (doc_id) where decision = 'INCLUDE'")
def q_list_by_decision(spark, t):
    return t("documents").join(screening(t).filter("decision = 'INCLUDE'"), "doc_id").select("doc_id", T.title(F.col("text")).alias("title"))


@query("""with @S, x as (select source, case when lang <> 'en' then 'E8' when n_chars < 1000 then '' when n_chars < 2500 then 'E9' end as code from documents join s using (doc_id) where decision = 'EXCLUDE')
 select code, coalesce(code, 'UNKNOWN') as label, count(*) as cnt, string_agg(distinct source, ',' order by source) as reasons from x group by code""")
def q_exclusion_distribution(spark, t):
    code = F.when(F.col("lang") != "en", "E8").when(F.col("n_chars") < 1000, "").when(F.col("n_chars") < 2500, "E9")
    excluded = t("documents").join(screening(t).filter("decision = 'EXCLUDE'"), "doc_id").select("source", code.alias("code"))
    return progress.exclusion_distribution(excluded, "code", "source")


@query("""with @S, @D, k as (select j.* from j join s using (doc_id) where decision = 'INCLUDE'), u as (unpivot (select p, i, c, o, s from k) on p, i, c, o, s into name dim value result)
 select dim, result, count(*) as n, cast(sum(case when result = 'PASS' then count(*) else 0 end) over (partition by dim) as double) / cast(sum(count(*)) over (partition by dim) as double) as pass_rate from u group by dim, result""")
def q_dimension_stats(spark, t):
    kept = judged(t).join(screening(t).filter("decision = 'INCLUDE'"), "doc_id")
    return progress.dimension_stats(kept.select(*decisions.DIMENSIONS), decisions.DIMENSIONS)


@query("with @S select doc_id from s where decision = 'INCLUDE' and doc_id not in (select page_id from pages)")
def q_include_missing_asset(spark, t):
    return screening(t).filter("decision = 'INCLUDE'").join(t("pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("select user_id as run, min(ts) as first_ts, max(ts) as last_ts, count(distinct cast(ts as date)) as active_days from events group by 1")
def q_activity_range(spark, t):
    return events(t).groupBy("run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.to_date("ts")).alias("active_days"))


@query("select cast(year(o_orderdate) as int) as year, o_orderstatus as status, count(*) as n from orders group by 1, 2")
def q_year_status(spark, t):
    return progress.count_by(t("orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")), "year", "status")


@query("select cast(year(o_orderdate) as int) as year, count(*) as n from orders where o_orderstatus = 'F' group by 1")
def q_year_hist(spark, t):
    return progress.count_by(t("orders").filter("o_orderstatus = 'F'").select(F.year("o_orderdate").alias("year")), "year")


@query("with @S select doc_id, decision, lang, source, n_chars, left(split_part(text, chr(10), 1), 60) as title from documents join s using (doc_id)")
def q_export(spark, t):
    return t("documents").join(screening(t), "doc_id").select("doc_id", "decision", "lang", "source", "n_chars", F.left(T.title(F.col("text")), F.lit(60)).alias("title"))


@query("""with @S, c as (select 'total' as "check", (select count(*) from documents) as expected, (select count(distinct doc_id) from documents) as actual
 union all select 'conservation', (select count(*) from documents), (select count(*) from s) + (select count(*) from documents where doc_id not in (select doc_id from s))
 union all select 'orphans', 0, (select count(*) from s where doc_id not in (select doc_id from documents))
 union all select 'decisions', (select count(*) from s), (select count(*) from s where decision in ('INCLUDE', 'EXCLUDE')))
 select "check", expected, actual, expected = actual as ok from c""")
def q_consistency(spark, t):
    docs, s = t("documents").select("doc_id"), screening(t)
    n = lambda df: df.agg(F.count("*"))
    return progress.consistency([
        ("total", n(docs), docs.agg(F.countDistinct("doc_id"))),
        ("conservation", n(docs), s.select("doc_id").unionByName(docs.join(s, "doc_id", "left_anti")).agg(F.count("*"))),
        ("orphans", s.agg(F.lit(0).cast("long")), n(s.join(docs, "doc_id", "left_anti"))),
        ("decisions", n(s), n(s.filter(F.col("decision").isin("INCLUDE", "EXCLUDE")))),
    ])


#: Rules that hit this corpus, in the order in which they are tried.
CORPUS_PATTERNS = [r"^this\s+work\s+is", r"^licensed\s+under", r"^the\s+t"]
CORPUS_KEYWORDS = ["copyright", "password", "@", "of the "]
PRESCREEN_SQL = """r as (select doc_id, case when regexp_matches(lower(split_part(text, chr(10), 1)), '^this\\s+work\\s+is') then 1 when regexp_matches(lower(split_part(text, chr(10), 1)), '^licensed\\s+under') then 2
 when regexp_matches(lower(split_part(text, chr(10), 1)), '^the\\s+t') then 3 when contains(lower(split_part(text, chr(10), 1)), 'copyright') then 4 when contains(lower(split_part(text, chr(10), 1)), 'password') then 5
 when contains(lower(split_part(text, chr(10), 1)), '@') then 6 when contains(lower(split_part(text, chr(10), 1)), 'of the ') then 7 end as rule_id from documents)""".replace("\\\\", "\\")


@query(f"with {PRESCREEN_SQL} select doc_id, cast(rule_id as int) as rule_id, list_value('pattern: ^this\\s+work\\s+is', 'pattern: ^licensed\\s+under', 'pattern: ^the\\s+t', 'keyword: copyright', 'keyword: password', 'keyword: @', 'keyword: of the ')[rule_id] as reason from r where rule_id is not null")
def q_prescreen_rules(spark, t):
    hit = matching.first_rule(T.title(F.col("text")), CORPUS_PATTERNS, CORPUS_KEYWORDS)
    return t("documents").select("doc_id", hit.alias("hit")).filter("hit is not null").select("doc_id", "hit.rule_id", "hit.reason")


def confusion(t) -> DataFrame:
    model = F.when(F.col("n_chars") < 100, "UNCERTAIN").when(F.contains("text", F.lit(" | ")) | F.contains("text", F.lit("***")), "REVIEW").otherwise("NOT_REVIEW")
    rows = t("documents").select("doc_id", model.alias("model")).join(screening(t), "doc_id", "left").select("model", F.coalesce("decision", F.lit("PENDING")).alias("rule")).filter(F.col("rule").isin("EXCLUDE", "PENDING"))
    ex, review = F.col("rule") == "EXCLUDE", F.col("model") == "REVIEW"
    label = F.when(F.col("model") == "UNCERTAIN", "uncertain").when(ex & review, "confirmed_exclude").when(ex, "false_positive").when(review, "missed_review").otherwise("confirmed_include")
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


CONFUSION_SQL = SCREENING_SQL + """, m as (select case when n_chars < 100 then 'UNCERTAIN' when contains(text, ' | ') or contains(text, '***') then 'REVIEW' else 'NOT_REVIEW' end as model, coalesce(decision, 'PENDING') as rule from documents left join s using (doc_id) where s.doc_id is null or decision = 'EXCLUDE'),
 f as (select case when model = 'UNCERTAIN' then 'uncertain' when rule = 'EXCLUDE' then case when model = 'REVIEW' then 'confirmed_exclude' else 'false_positive' end when model = 'REVIEW' then 'missed_review' else 'confirmed_include' end as label, count(*) as n from m group by 1)"""


@query(f"with {CONFUSION_SQL} select label, n from f")
def q_confusion(spark, t):
    return confusion(t)


@query(f"with {CONFUSION_SQL} select cast(coalesce(sum(n) filter (where label = 'confirmed_exclude'), 0) as bigint) as confirmed, cast(coalesce(sum(n) filter (where label = 'false_positive'), 0) as bigint) as wrong, cast(sum(n) filter (where label = 'confirmed_exclude') as double) / sum(n) filter (where label in ('confirmed_exclude', 'false_positive')) as accuracy from f")
def q_rule_accuracy(spark, t):
    of = lambda x: F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0))
    out = confusion(t).agg(of("confirmed_exclude").alias("confirmed"), of("false_positive").alias("wrong"))
    return out.withColumn("accuracy", F.try_divide("confirmed", F.col("confirmed") + F.col("wrong")))


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\.)?', ''), '[?#].*$', ''), '[/.,;)]+$', '') as url_norm, regexp_replace(regexp_replace(lower(trim(url)), '^https?://(dx\.)?doi\.org/', ''), '[.,;)]+$', '') as doi from pages")
def q_url_normalize(spark, t):
    return t("pages").select("page_id", T.normalize_url(F.col("url")).alias("url_norm"), T.normalize_doi(F.col("url")).alias("doi"))


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda x: length(x) >= 4)"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS) + "]"


@query(f"select doc_id, cast(len(list_filter(list_distinct({tokens_sql('split_part(text, chr(10), 1)')}), lambda w: not list_contains({STOP_SQL}, w))) as int) as n_tokens, md5({norm_sql('text')}) as norm_md5 from documents")
def q_title_tokens(spark, t):
    return t("documents").select("doc_id", F.size(T.title_tokens(T.title(F.col("text")))).alias("n_tokens"), F.md5(T.normalize(F.col("text")).cast("binary")).alias("norm_md5"))


OVERLAP_SQL = rf"""p as (select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, {norm_sql("regexp_extract(html, '(?is)<body>(.*)</body>', 1)")} as body from pages),
 k as (select page_id, list_filter(list_distinct({tokens_sql('title')}), lambda w: not list_contains({STOP_SQL}, w)) as tk, body from p)"""


@query(f"with {OVERLAP_SQL} select page_id, cast(len(tk) as int) as n_tokens, case when len(tk) = 0 then 1.0::double else len(list_filter(tk, lambda w: contains(body, w)))::double / len(tk) end as share from k")
def q_title_overlap(spark, t):
    rows = t("pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), T.normalize(F.regexp_extract("html", r"(?is)<body>(.*)</body>", 1)).alias("body"))
    rows = rows.withColumn("tk", T.title_tokens(F.col("title")))
    return rows.select("page_id", F.size("tk").alias("n_tokens"), T.overlap(F.col("tk"), F.col("body")).alias("share"))


@query("""with h as (select sha256(text) as sha, doc_id, source, lang from documents), g as (select sha, count(*) as n, min(doc_id) as first_uid,
 count(distinct source) as n_source, count(distinct lang) as n_lang, case when count(distinct source) > 1 or count(distinct lang) > 1 then 'FAIL' else 'INFO' end as severity from h group by 1 having count(*) > 1) select g.*, doc_id from g join h using (sha)""")
def q_shared_hash(spark, t):
    rows = t("documents").select("doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return gates.shared_hash(rows, "doc_id", "sha", "source", "lang")


LOCK_SQL = SCREENING_SQL + r""", lock as (select case when doc_id % 40 = 7 then doc_id - doc_id % 2 else doc_id end as uid, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, case when page_id % 25 = 3 then sha256('x') else sha256(html) end as sha256 from s join pages on page_id = doc_id where decision = 'INCLUDE'),
 asset as (select page_id as uid, split_part(text, chr(10), 1) as asset_title, sha256(html) as asset_sha from pages join documents on doc_id = page_id where page_id % 11 <> 4), """


def lock(t) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    sha = F.sha2(F.when(F.col("page_id") % 25 == 3, "x").otherwise(F.col("html")).cast("binary"), 256)
    uid = F.when(F.col("doc_id") % 40 == 7, F.col("doc_id") - F.col("doc_id") % 2).otherwise(F.col("doc_id"))
    return screening(t).filter("decision = 'INCLUDE'").join(t("pages"), F.col("page_id") == F.col("doc_id")).select(uid.alias("uid"), title.alias("title"), sha.alias("sha256"))


@query(f"""with {LOCK_SQL} f as (select l.uid, l.title, l.sha256, a.* exclude (uid) from lock l left join asset a on a.uid = l.uid),
 g as (select *, list_filter(list_distinct({tokens_sql('title')}), lambda w: not list_contains({STOP_SQL}, w)) as tk, {norm_sql('asset_title')} as nt from f)
 select 'FAIL' as severity, 'lock' as scope, cast(uid as varchar) as uid, 'uid repeated' as message, cast(count(*) as varchar) as evidence from lock group by uid having count(*) > 1
 union all select 'FAIL', 'asset', cast(uid as varchar), 'asset missing', '' from f where asset_sha is null
 union all select 'FAIL', 'asset', cast(uid as varchar), 'sha256 differs', left(asset_sha, 12) from f where asset_sha <> sha256
 union all select 'WARN', 'asset', cast(uid as varchar), 'title overlap low', cast(len(tk) as varchar) from g where asset_title is not null and len(tk) > 0 and len(list_filter(tk, lambda w: contains(nt, w)))::double / len(tk) < 0.35""")
def q_lock_issues(spark, t):
    assets = t("pages").filter("page_id % 11 <> 4").join(t("documents").select("doc_id", "text"), F.col("doc_id") == F.col("page_id")).select(F.col("page_id").alias("uid"), T.title(F.col("text")).alias("title"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    return gates.lock_issues(lock(t), assets)


@query("""with @S, l as (select doc_id as uid from documents where doc_id % 3 <> 0), x as (select doc_id as uid from documents where doc_id % 15 = 0),
 b as (select coalesce(l.uid, s.doc_id) as uid, l.uid is not null as locked, decision, x.uid is not null as barred from l full join s on s.doc_id = l.uid left join x on x.uid = coalesce(l.uid, s.doc_id))
 select case when locked or not barred then 'WARN' else 'FAIL' end as severity, 'database' as scope, cast(uid as varchar) as uid, case when locked then 'locked but not included' when barred then 'included but excluded by administrator' else 'included but not locked' end as message, decision as evidence
 from b where (locked and decision <> 'INCLUDE') or (not locked and decision = 'INCLUDE')""")
def q_lock_vs_db(spark, t):
    uid = t("documents").select(F.col("doc_id").alias("uid"))
    return gates.lock_vs_database(uid.filter("uid % 3 <> 0"), screening(t).withColumnRenamed("doc_id", "uid"), uid.filter("uid % 15 = 0"))


@query(f"with d as (select doc_id, {norm_sql('text')} as norm from documents), b as (select item_id, {norm_sql('text')} as quote from benchmark) select item_id, doc_id from b join d on contains(norm, quote) where quote <> ''")
def q_quote_exact(spark, t):
    return terms.quotes_in(t("documents"), t("benchmark"))


RATIO_SQL = f"d as (select doc_id, {norm_sql('text')} as norm from documents), b as (select item_id, {tokens_sql('text')} as tk from benchmark), x as (select item_id, doc_id, len(list_filter(tk, lambda w: contains(norm, w))) as hits, len(tk) as tokens from b, d where len(tk) > 0)"


@query(f"with {RATIO_SQL} select item_id, doc_id, hits, tokens from x where hits >= 0.72::double * tokens")
def q_quote_ratio(spark, t):
    return terms.overlapping(t("documents"), t("benchmark")).select("item_id", "doc_id", "hits", "tokens")


@query(f"""with {RATIO_SQL}, f as (select item_id from x where hits >= 0.72::double * tokens group by 1), u as (select b.item_id // 4 as uid, count(*) as n from b left join f using (item_id) where f.item_id is null group by 1)
 select case when n >= 2 then 'HIGH' else 'MEDIUM' end as severity, uid, 'evidence_not_found' as category, n from u""")
def q_grounding_findings(spark, t):
    """Records of four quotes each: those of which quotes are in no document."""
    found = terms.overlapping(t("documents"), t("benchmark")).select("item_id").distinct()
    missing = t("benchmark").join(found, "item_id", "left_anti").groupBy(F.expr("item_id div 4").alias("uid")).agg(F.count("*").alias("n"))
    return gates.grounding_findings(missing)


#: Audit rules that hit this corpus.
CORPUS_RULES = [("HIGH", "license_without_source", "T", ["licensed under", "general public license", "cc by"], "T", ["copyright"], 1), ("MEDIUM", "contact", "T", ["mail", "example com", "555"], "T", ["password", "token", "key"], 2)]
RISK_SQL = f"n as (select doc_id, {norm_sql('text')} as norm from documents), h as (select doc_id, list_filter(['licensed under', 'general public license', 'cc by'], lambda w: contains(norm, w)) as a, list_filter(['copyright'], lambda w: contains(norm, w)) as b, list_filter(['mail', 'example com', '555'], lambda w: contains(norm, w)) as c, list_filter(['password', 'token', 'key'], lambda w: contains(norm, w)) as d from n)"


@query(f"with {RISK_SQL} select 'HIGH' as severity, doc_id as uid, 'license_without_source' as category, array_to_string(a, ', ') as evidence from h where len(a) > 0 and len(b) < 1 union all select 'MEDIUM', doc_id, 'contact', array_to_string(c, ', ') from h where len(c) > 0 and len(d) < 2")
def q_risk_findings(spark, t):
    return gates.audit_findings(t("documents"), "doc_id", {"T": F.col("text")}, CORPUS_RULES)


DERIVE_SQL = """, v as (select *, case when p = 'FAIL' then 'E1' when i = 'FAIL' then 'E2' when o = 'FAIL' then case when regexp_matches(lower(title), 'knowledge|cognitive|written test|mcq|multiple-choice|quiz|attitude|satisfaction|confidence|self-efficacy') then 'E3' else 'E4' end
 when c = 'FAIL' then case when regexp_matches(lower(title), 'junior|senior|expert|novice|experienced|known-groups|known groups|messick|vr-only|internal vr') then 'E10' else 'E5' end when s = 'FAIL' then 'E6' end as derived_code from j),
 w as (select *, case when p = 'PASS' and i = 'PASS' and c = 'PASS' and o = 'PASS' and s = 'PASS' then 'INCLUDE' when derived_code is not null then 'EXCLUDE' else 'MAYBE' end as derived_decision from v)"""


@query("with @D" + DERIVE_SQL + " select doc_id, derived_decision, derived_code from w")
def q_derive_decision(spark, t):
    return decisions.derive(judged(t), F.col("title"), F.col("title")).select("doc_id", "derived_decision", "derived_code")


@query("with @S, @D".replace("@S", SCREENING_SQL.replace("s as (", "z as (", 1)) + DERIVE_SQL + """, k as (select w.*, decision, case when decision = 'EXCLUDE' then 'E1' end as code from w join z using (doc_id)),
 g as (select *, list_filter([case when decision <> derived_decision then 'decision_mismatch' end, case when decision = derived_decision and derived_decision = 'EXCLUDE' and code is distinct from derived_code then 'code_mismatch' end,
 case when derived_decision = 'EXCLUDE' and derived_code = 'E4' and o = 'FAIL' and regexp_matches(lower(title), 'transfer|operating room|or performance|real-world|real world|novel task|follow-up|follow up|retention|delayed|weeks|months') then 'transfer_signal' end], lambda x: x is not null) as q from k)
 select doc_id, decision, array_to_string(q, ';') as issues, case when len(q) > 0 then 'MAYBE' else derived_decision end as final_decision, case when len(q) = 0 and derived_decision = 'EXCLUDE' then derived_code end as final_code from g""")
def q_hard_gate(spark, t):
    rows = judged(t).join(screening(t), "doc_id").withColumn("code", F.when(F.col("decision") == "EXCLUDE", "E1"))
    out = decisions.hard_gate(decisions.derive(rows, F.col("title"), F.col("title")), F.col("title"), F.col("title"))
    return out.select("doc_id", "decision", F.array_join("gate_issues", ";").alias("issues"), "final_decision", "final_code")


@query("""with @S, k as (select doc_id, decision, case when doc_id % 2 = 0 then 'E1' end as code, case when doc_id % 5 > 0 then 'x' else ' ' end as path from s)
 select doc_id as key, 'invalid code' as issue from k where decision = 'EXCLUDE' and code is null union all select doc_id, 'include without document' from k where decision = 'INCLUDE' and trim(path) = ''
 union all select k.doc_id, 'i: invalid result' from k join documents d on d.doc_id = k.doc_id where n_chars < 100""")
def q_quality_issues(spark, t):
    rows = judged(t).join(screening(t), "doc_id").withColumn("i", F.when(F.col("n_chars") < 100, "bad").otherwise(F.col("i")))
    rows = rows.select(F.col("doc_id").alias("key"), "decision", F.when(F.col("doc_id") % 2 == 0, "E1").alias("code"), F.when(F.col("doc_id") % 5 > 0, "x").otherwise(" ").alias("path"), *decisions.DIMENSIONS)
    return decisions.validate(rows)


AUDIT_SQL = SCREENING_SQL + """, a as (select doc_id, list_filter([case when decision = 'INCLUDE' and contains(text, ' | ') then 'TABLE_INCLUDED' end, case when decision = 'EXCLUDE' and n_chars > 3000 then 'LONG_EXCLUDED' end, case when decision = 'INCLUDE' and contains(text, '@') then 'CONTACT_INCLUDED' end,
 case when contains(lower(text), 'licensed under') then 'LICENSE' end], lambda x: x is not null) as c from documents join s using (doc_id))"""


def rule_audit(t) -> DataFrame:
    rows = t("documents").join(screening(t), "doc_id")
    include = F.col("decision") == "INCLUDE"
    found = F.array_compact(F.array(
        F.when(include & F.contains("text", F.lit(" | ")), "TABLE_INCLUDED"), F.when((F.col("decision") == "EXCLUDE") & (F.col("n_chars") > 3000), "LONG_EXCLUDED"),
        F.when(include & F.contains("text", F.lit("@")), "CONTACT_INCLUDED"), F.when(F.contains(F.lower("text"), F.lit("licensed under")), "LICENSE"),
    ))
    return rows.select("doc_id", F.array_join(found, ";").alias("risk_categories")).filter("risk_categories <> ''")


@query(f"with {AUDIT_SQL} select doc_id, array_to_string(c, ';') as risk_categories from a where len(c) > 0")
def q_rule_audit(spark, t):
    return rule_audit(t)


@query(f"with {AUDIT_SQL} select unnest(c) as category, count(*) as n from a group by 1")
def q_rule_audit_counts(spark, t):
    return progress.count_by(rule_audit(t).select(F.explode(F.split("risk_categories", ";")).alias("category")), "category")


@query("with @S, r as (select *, row_number() over (partition by decision order by md5('42|' || cast(doc_id as varchar)), doc_id) as k, count(*) over (partition by decision) as n from s) select doc_id, decision from r where k <= least(n, greatest(5, ceil(n * 0.1::double)))")
def q_qa_sample(spark, t):
    return runs.stratified_sample(screening(t), "decision", "doc_id", 0.1, 5, "42")


@query("select doc_id, left(md5(text || '|' || 'rules-1' || '|' || lang || '|' || source), 16) as fingerprint, left(md5(split_part(text, chr(10), 1)), 6) as title_hash from documents")
def q_fingerprint(spark, t):
    return t("documents").select("doc_id", T.fingerprint(F.col("text"), F.lit("rules-1"), F.col("lang"), F.col("source")).alias("fingerprint"), T.md5_prefix(T.title(F.col("text")), 6).alias("title_hash"))


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' \n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) as squeezed_md5 from documents")
def q_text_normalize(spark, t):
    return t("documents").select("doc_id", F.md5(T.squeeze(F.col("text")).cast("binary")).alias("squeezed_md5"))


@query(rf"select doc_id, case when length(text) < 100 then 1.0::double else 1 - length(regexp_replace(text, '{T.READABLE}', '', 'g'))::double / length(text) end as unreadable from documents")
def q_text_quality(spark, t):
    return t("documents").select("doc_id", T.unreadable_ratio(F.col("text")).alias("unreadable"))


@query(r"select doc_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', 'sk-***', 'g'), '(?i)Bearer\s+[A-Za-z0-9._-]+', 'Bearer ***', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '***@***', 'g'), '[\r\n]', ' ', 'g'), 800) as redacted from documents")
def q_redact(spark, t):
    return t("documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def q_event_json(spark, t):
    return t("events").select("event_id", T.parse_object(F.col("props"), "k int")["k"].alias("k"))


NOW = "2024-01-31 12:00:00"


@query(f"""with r as (select user_id as run, count(*) as n_events, count(*) filter (where event_type = 'error') as n_failed, count(*) filter (where event_type = 'purchase') as n_done, max(ts) as last_ts, arg_max(event_type, (ts, event_id)) as last_state from events group by 1),
 a as (select *, datesub('second', last_ts, timestamp '{NOW}') as age_seconds from r), b as (select *, case when last_state = 'purchase' then 'completed' when age_seconds > 600 then 'stale' else 'running_or_recent' end as status from a)
 select *, status = 'stale' and n_failed > 0 as can_resume from b""")
def q_run_status(spark, t):
    return runs.run_status(events(t), NOW, "purchase", "error")


@query("select * from (select user_id as run, event_id, event_type as state, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as place from events) where place <= 20")
def q_recent_events(spark, t):
    return runs.recent(events(t)).select("run", "event_id", "state", "place")


@query("select event_id, count(*) over w as requests, cast(round(sum(value) over w * 100) as bigint) as cents from events window w as (partition by user_id order by ts range between interval 60 minutes preceding and current row)")
def q_rate_window(spark, t):
    return runs.rate_window(events(t)).select("event_id", "requests", F.round(F.col("tokens_sum") * 100).cast("long").alias("cents"))


@query()
def q_rate_admission(spark, t):
    """When each event is admitted if at most two (0.8 of three), and 120 tokens, are in six hours of its run."""
    rows = events(t).select(F.col("run").alias("key"), F.col("event_id").alias("id"), "ts", F.round("tokens").cast("long").alias("tokens"))
    return limiter.admission(rows, 6 * 3600, 3, 150, span_seconds=7 * 86400).select(F.col("key").alias("run"), F.col("id").alias("event_id"), "admitted_at", "wait_seconds")


@query("with e as (select user_id as run, max(event_id) as at from events group by 1), c as (select conv_id as run, max(turn) as at from conversations group by 1) select coalesce(e.run, c.run) as run, case when e.run is not null and c.run is not null then 'PAIRED' else 'UNPAIRED' end as pairing, greatest(e.at, c.at) as newest from e full join c on e.run = c.run")
def q_pairing(spark, t):
    return runs.pairing(t("events").groupBy(F.col("user_id").alias("run")).agg(F.max("event_id").alias("at")), t("conversations").groupBy(F.col("conv_id").alias("run")).agg(F.max("turn").alias("at")))


@query("select conv_id, count(*) filter (where role = 'assistant') as n_assistant, max(turn) as last_turn, arg_max(role, turn) as last_role from conversations group by 1")
def q_transcript_last(spark, t):
    return t("conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


@query("select source, count(*) as n, min(n_chars) as least, max(n_chars) as most, list_sort(list(n_chars))[count(*) // 2 + 1] as upper_median from documents group by 1")
def q_upper_median(spark, t):
    return progress.upper_median(t("documents").select("source", "n_chars"), "source", "n_chars")


@query("select page_id, left(trim(split_part(split_part(html, '<title>', 2), '</title>', 1)), 150) as head, left(trim(split_part(split_part(html, '<p>', 2), '</p>', 1)), 400) as first_paragraph from pages")
def q_section_extract(spark, t):
    part = lambda tag, n: F.left(F.trim(F.split_part(F.split_part("html", F.lit(f"<{tag}>"), F.lit(2)), F.lit(f"</{tag}>"), F.lit(1))), F.lit(n))
    return t("pages").select("page_id", part("title", 150).alias("head"), part("p", 400).alias("first_paragraph"))


#: Letters whose compatibility forms a text is given, which NFKC has to undo.
COMPATIBLE = {"fi": "\ufb01", "0": "\uff10", "A": "\uff21", "th": "t\u02b0"}


@query("select doc_id, md5(nfc_normalize(text)) as nfkc_md5, md5(trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g'))) as quote_md5 from documents")
def q_nfkc_normalize(spark, t):
    """Texts with ligatures, full-width and modifier letters in place of plain ones, back to plain text."""
    text = F.col("text")
    for plain, other in COMPATIBLE.items():
        text = F.replace(text, F.lit(plain), F.lit(other))
    return t("documents").select("doc_id", T.nfkc(text).alias("n")).select("doc_id", F.md5(F.col("n").cast("binary")).alias("nfkc_md5"), F.md5(T.quote_normal(F.col("n")).cast("binary")).alias("quote_md5"))


@query()
def q_fuzzy_match(spark, t):
    """Page titles against the titles of documents: the best five of all that score 0.3 or more."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    right = t("documents").select(F.col("doc_id").alias("other"), T.title(F.col("text")).alias("name"))
    return matching.best_matches(t("pages").select(F.col("page_id").alias("id"), title.alias("name")), right)


from tamis.plans import audit, more  # noqa: E402,F401  (register their queries)
