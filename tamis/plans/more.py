"""Queries of sources, judges and streams; see ``catalogue``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.functions import text as T
from tamis.operators import decisions, judging, progress, runs, shared, store
from tamis.plans.catalogue import events, judged, query, screening
from tamis.sources import files, ris
from tamis.streaming import supervisor


@query(r"""with d as (select doc_id, source, lang, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) as title from documents)
 select doc_id, title, cast(2000 + doc_id % 25 as int) as year, source || 'Q_' || cast(2000 + doc_id % 25 as varchar) || '_' || left(md5(title), 6) as key, 'Src' || source || ', Q.; Second, A.' as authors_str, lang as language from (select doc_id, regexp_replace(source, '[^a-zA-Z]', '', 'g') as source, lang, title from d) where title <> ''""".replace("source || 'Q_'", "'Src' || source || 'Q_'"))
def q_ris_import(spark, t):
    """Documents written as RIS records, fifty to a text, and parsed back."""
    title = F.trim(F.regexp_replace(T.title(F.col("text")), r"\s+", " "))
    name = F.regexp_replace("source", "[^a-zA-Z]", "")
    record = F.concat(F.lit("TY  - JOUR\nTI  - "), title, F.lit("\nAU  - Src"), name, F.lit(", Q.\nAU  - Second, A.\nPY  - "), (2000 + F.col("doc_id") % 25).cast("string"), F.lit("/05/01\nLA  - "), F.col("lang"), F.lit("\nAN  - "), F.col("doc_id").cast("string"), F.lit("\nER  - \n"))
    files = t("documents").select(F.expr("doc_id div 50").cast("string").alias("path"), F.struct("doc_id", record.alias("r")).alias("r")).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["r"]), "").alias("content"))
    return ris.parse(files).select(F.col("accession_number").cast("long").alias("doc_id"), "title", "year", "key", "authors_str", "language")


@query("""with m as (select *, coalesce(datesub('second', lag(ts) over w, ts) > 3600, true) as fresh from events window w as (partition by user_id order by ts, event_id)),
 k as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from m)
 select user_id as run, cast(session as bigint) as session, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from k group by 1, 2""")
def q_heartbeat_sessions(spark, t):
    return runs.sessions(events(t))


@query("""with j as (select doc_id, case when n_chars < 100 then 'UNCERTAIN' when contains(lower(text), 'review') then 'FAIL' else 'PASS' end as p, case when n_chars < 100 then 'UNCERTAIN' when n_chars < 200 then 'FAIL' else 'PASS' end as i,
 case when n_chars < 100 then 'UNCERTAIN' when contains(lower(text), 'licensed under') then 'FAIL' else 'PASS' end as c, case when n_chars < 100 then 'UNCERTAIN' when contains(text, '@') then 'FAIL' else 'PASS' end as o,
 case when n_chars < 100 then 'UNCERTAIN' when contains(text, ' | ') then 'FAIL' else 'PASS' end as s from documents)
 select case when n.code is not null then 'EXCLUDE' when p = 'UNCERTAIN' then 'MAYBE' else 'INCLUDE' end as decision, n.code as code, count(*) as n from (select *, case when p = 'FAIL' then 'E1' when i = 'FAIL' then 'E2' when o = 'FAIL' then 'E4' when c = 'FAIL' then 'E5' when s = 'FAIL' then 'E6' end as code from j) n group by 1, 2""")
def q_judge(spark, t):
    judged = judging.judge_all(t("documents"), judging.RuleJudge())
    out = decisions.derive(judged, F.col("reason"), F.col("reason"))
    return out.groupBy(F.col("derived_decision").alias("decision"), F.col("derived_code").alias("code")).agg(F.count("*").alias("n"))


RULES_SQL = """select doc_id, case when n < 100 then 'UNCERTAIN' when contains(lower(t), 'review') then 'FAIL' else 'PASS' end as p, case when n < 100 then 'UNCERTAIN' when n < 200 then 'FAIL' else 'PASS' end as i,
 case when n < 100 then 'UNCERTAIN' when contains(lower(t), 'licensed under') then 'FAIL' else 'PASS' end as c, case when n < 100 then 'UNCERTAIN' when contains(t, '@') then 'FAIL' else 'PASS' end as o,
 case when n < 100 then 'UNCERTAIN' when contains(t, ' | ') then 'FAIL' else 'PASS' end as s, case when n < 100 then 'too short' else '' end as reason from (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents)"""
FLAKY_SQL = """d as (select doc_id, a, instr('0123456789abcdef', left(md5(doc_id || ':' || a), 1)) - 1 as x from documents, (values (0), (1), (2)) v(a)),
 f as (select *, case when x < 4 then 'rate_limited' when x < 6 then 'failed' when x = 6 then 'severe' end as problem from d),
 t as (select * from f f1 where not exists (select 1 from f f2 where f2.doc_id = f1.doc_id and f2.a < f1.a and f2.problem is null))"""


@query("with " + FLAKY_SQL + " select doc_id, cast(a as int) as attempt, problem, cast(case when a = 2 then 0 when problem = 'rate_limited' then 30 * (1 << a) when problem = 'failed' then 5 else 0 end as int) as wait_seconds from t")
def q_judge_attempts(spark, t):
    """What each attempt of a judge came to that fails by a hash, with the wait after it."""
    return judging.judge_with_retries(t("documents"), judging.FlakyJudge(judging.RuleJudge())).select("doc_id", "attempt", "problem", "wait_seconds")


@query("with " + FLAKY_SQL + ", r as (" + RULES_SQL + """), e as (select * from t where problem is null or a = 2)
 select doc_id, case when problem is null then p else 'UNCERTAIN' end as p, case when problem is null then i else 'UNCERTAIN' end as i, case when problem is null then c else 'UNCERTAIN' end as c, case when problem is null then o else 'UNCERTAIN' end as o,
 case when problem is null then s else 'UNCERTAIN' end as s, case when problem is null then reason else 'given up after 3 attempts' end as reason, cast(a + 1 as int) as attempts from e join r using (doc_id)""")
def q_judge_verdicts(spark, t):
    """Verdicts after up to three attempts each."""
    return judging.verdicts(judging.judge_with_retries(t("documents"), judging.FlakyJudge(judging.RuleJudge())))


@query("""with e as (select user_id as run, epoch_us(ts) // 1000 as beat, bool_or(event_type = 'purchase') as finished from events group by 1, 2),
 g as (select run, beat, finished, coalesce(lead(beat) over (partition by run order by beat), epoch_ms(timestamp '2024-02-05 00:00:00') + 1) as stop from e),
 k as (select run, beat, unnest(generate_series(beat + 86400000, stop - 1, 36000000)) as at_ms from g where not finished)
 select run, at_ms, beat as last_ms, cast((at_ms - beat - 86400000) // 36000000 + 1 as int) as nth from k""")
def q_resume_launches(spark, t):
    """Launches of runs that were silent for a day, again every ten hours; a purchase ends a run."""
    heartbeats = t("events").select(F.col("user_id").alias("run"), "ts", (F.col("event_type") == "purchase").alias("finished"))
    return supervisor.launches(heartbeats, "2024-02-05 00:00:00", 86400, 36000)


@query("""with @S, @D, x as (select j.*, decision, case when decision <> 'EXCLUDE' then '' when p = 'FAIL' then 'E1' when i = 'FAIL' then 'E2' else 'E9' end as code from j join s using (doc_id))
 select cast(doc_id as varchar) as "Key", cast(null as varchar) as "Author", cast(null as varchar) as "Year", title as "Title", cast(null as varchar) as "DOI", decision as "最终决策", code as "排除码", cast(null as varchar) as "判定理由", cast(null as varchar) as "筛选日期",
 p as "P判定", i as "I判定", cast(null as varchar) as "设备类型", c as "C判定", o as "O判定", cast(null as varchar) as "结局类型", s as "S判定", cast(null as varchar) as "设计类型", decision || '/' || doc_id || '.md' as "MD文件" from x""")
def q_export_sheet(spark, t):
    """The export's 18 columns under their own headings; what the tables don't have is empty."""
    code = F.when(F.col("decision") != "EXCLUDE", "").when(F.col("p") == "FAIL", "E1").when(F.col("i") == "FAIL", "E2").otherwise("E9")
    rows = judged(t).join(screening(t), "doc_id").withColumn("key", F.col("doc_id").cast("string"))
    return files.export_columns(rows.withColumn("code", code).withColumn("record", F.concat("decision", F.lit("/"), "key", F.lit(".md"))))


@query("""with @S, e as (select doc_id from documents where lang = 'en'), es as (select * from s where doc_id in (select doc_id from e)),
 n as (select 'stored' as k, (select count(*) from e) as total, (select count(*) from es) as processed, (select count(*) from e where doc_id not in (select doc_id from s)) as remaining, (select count(*) from es where decision = 'INCLUDE') as include_count,
  (select count(*) from es where decision = 'EXCLUDE') as exclude_count, (select count(*) from es where decision = 'MAYBE') as maybe_count
  union all select 'real', (select count(*) from documents), (select count(*) from s), (select count(*) from documents where doc_id not in (select doc_id from s)), (select count(*) from s where decision = 'INCLUDE'), (select count(*) from s where decision = 'EXCLUDE'), (select count(*) from s where decision = 'MAYBE')),
 u as (unpivot n on total, processed, remaining, include_count, exclude_count, maybe_count into name subject value v)
 select 'cache' as "check", a.subject, cast(b.v as varchar) as expected, cast(a.v as varchar) as actual from u a join u b on a.subject = b.subject and a.k = 'stored' and b.k = 'real' and a.v <> b.v
 union all select 'conservation', 'processed + remaining', cast(total as varchar), cast(processed + remaining as varchar) from n where k = 'real' and total <> processed + remaining
 union all select 'file', cast(doc_id as varchar), 'records/' || doc_id || '.md', null from s where doc_id not in (select page_id from pages)""")
def q_cache_check(spark, t):
    """A progress that was stored before the documents of other languages came, and records whose file is missing."""
    path = lambda c: F.concat(F.lit("records/"), F.col(c).cast("string"), F.lit(".md")).alias("path")
    english, s = t("documents").filter("lang = 'en'").select("doc_id"), screening(t)
    stored = progress.progress(english, s.join(english, "doc_id", "left_semi"), "doc_id")
    return progress.verify(stored, t("documents"), s.select("*", path("doc_id")), "doc_id", t("pages").select(path("page_id")))


@query(r"""with @S, @D
 select doc_id, decision, case when decision = 'EXCLUDE' then 'E9' else '无' end as code, p as p_result, s as s_result, title as evidence from j join s using (doc_id)""")
def q_record_round_trip(spark, t):
    """Screening records written as Markdown and read back: decision, code, verdicts and quoted evidence."""
    rows = judged(t).join(screening(t), "doc_id")
    records = rows.select(
        F.col("doc_id").cast("string").alias("uid"), "decision", F.when(F.col("decision") == "EXCLUDE", "E9").alias("code"), "title",
        *[F.struct(F.col(d).alias("result"), (F.array("title") if d == "c" else F.array().cast("array<string>")).alias("evidence")).alias(d) for d in decisions.DIMENSIONS],
    )
    said = lambda name: F.regexp_extract("text", rf"\*\*{name}\*\*[^：\n]*：(.*)", 1)
    of = lambda d: files.result(files.section(F.col("text"), d))
    return files.markdown(records).select(
        F.col("uid").cast("long").alias("doc_id"), said("决策").alias("decision"), said("排除码").alias("code"), of("P").alias("p_result"), of("S").alias("s_result"),
        F.get(F.regexp_extract_all(files.section(F.col("text"), "C"), F.lit(r'(?m)^> "(.*)"$'), 1), 0).alias("evidence"),
    )


@query("""select d.doc_id, case when p.page_id is not null then 'page ' || p.url when l.doc_id is not null then 'label ' || coalesce(cast(l.quality as varchar), '') else coalesce(d.lang, '') end as state
 from documents d left join labels l on l.doc_id = d.doc_id left join pages p on p.page_id = d.doc_id union all select p.page_id, 'page ' || p.url from pages p where p.page_id not in (select doc_id from documents)""")
def q_keyed_store(spark, t):
    """Documents, then their labels, then pages of the same number, merged into a table by key in three batches."""
    table = store.KeyedTable(spark, f"{shared.folder(spark)}/tamis/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex[:12]}", StructType.fromDDL("doc_id long, state string"), "doc_id", 32)
    text = lambda word, c: F.concat(F.lit(word), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("state")
    for batch in (t("documents").select("doc_id", text("", "lang")), t("labels").select("doc_id", text("label ", "quality")), t("pages").select(F.col("page_id").alias("doc_id"), text("page ", "url"))):
        table.upsert(batch, "state")
    return table.read()
