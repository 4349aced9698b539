"""Queries of binding, judgement quality, audits, guards and reports; see ``catalogue``.

The corpus has nothing of the reviews that the rules are about, so sections, titles, names and
judgements are made of its texts with terms of the rules' own lists, alike in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import rules
from tamis.functions import text as T
from tamis.operators import binding, decisions, gates, progress, quality, reports, runs, terms
from tamis.plans.catalogue import NOW, SCREENING_SQL, STOP_SQL, events, judged, norm_sql, query, screening, tokens_sql


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def term(column: str, values: list[str], by: int) -> Column:
    """A term for each document, by its number (empty beyond the list); ``term_sql`` is the same in SQL."""
    return F.coalesce(F.get(F.array(*map(F.lit, values)), (F.col(column) % by).cast("int")), F.lit(""))


def term_sql(column: str, values: list[str], by: int) -> str:
    return f"coalesce([{', '.join(map(quoted, values))}][{column} % {by} + 1], '')"


def any_sql(x: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {quoted(t.lower())})" for t in terms) + ")"


# --- Pre-screening by the rules' own lists ---------------------------------------------------------
HEADS = ["A systematic review of ", "A  meta-analysis of ", "Review of the ", "Recent advances in ", "An update on ", "On recent progress, ", "Training: a literature review; ", "系统综述 ", "Knots and an overview, ", "VR trial of "]
HEAD_SQL = term_sql("doc_id", HEADS, 14)
FIRST_SQL = "case " + " ".join(f"when regexp_matches(lower(t), {quoted(p)}) then {i}" for i, p in enumerate(rules.REVIEW_PATTERNS, 1))
FIRST_SQL += " " + " ".join(f"when contains(lower(t), {quoted(k)}) then {i}" for i, k in enumerate(rules.REVIEW_KEYWORDS, 13)) + " end"


@query(f"with r as (select doc_id, {HEAD_SQL} || split_part(text, chr(10), 1) as t from documents) select doc_id, cast({FIRST_SQL} as int) as rule_id from r where {FIRST_SQL} is not null")
def q_review_rules(spark, t):
    texts = t("documents").select(F.col("doc_id").alias("key"), F.concat(term("doc_id", HEADS, 14), T.title(F.col("text"))).alias("text"))
    keywords = spark.createDataFrame(list(enumerate(rules.REVIEW_KEYWORDS, 1)), "term_id int, term string")
    return terms.first_rule(texts, rules.REVIEW_PATTERNS, keywords).select(F.col("key").alias("doc_id"), F.col("rule_id").cast("int").alias("rule_id"))


# --- Audits of records by their reasons ------------------------------------------------------------
C_TERMS = ["HMD vs desktop", "novice and expert", "no control group, pre-post", "control group", "both groups used VR", "single-arm", "traditional lectures; validation study", ""]
O_TERMS = ["knowledge test", "score and accuracy, retention", "same day questionnaire", "OSATS checklist", "MCQ", "随访", "immediately after; 3 months", "satisfaction", ""]
S_TERMS = ["pilot study", "randomized", "cross-sectional; control group", "feasibility", "known-groups", ""]
R_TERMS = ["应为INCLUDE", "all five pass", "plain reason", "VR-only", "operating room", "quiz", "", "", "", "", ""]
MADE = {"c": (C_TERMS, 8), "o": (O_TERMS, 9), "st": (S_TERMS, 7), "reason": (R_TERMS, 11)}
#: What a section has besides its term: the whole text, or its first line.
REAL_SQL = {"c": "' ' || d.text", "o": "' ' || split_part(d.text, chr(10), 1)", "st": "' ' || split_part(d.text, chr(10), 1)", "reason": "''"}
RECORDS_SQL = f"k as (select s.doc_id as key, s.decision, {', '.join(f'{term_sql("s.doc_id", *x)} || {REAL_SQL[name]} as {name}' for name, x in MADE.items())} from s join documents d on d.doc_id = s.doc_id)"


def records(t) -> DataFrame:
    real = {"c": F.concat(F.lit(" "), "text"), "reason": F.lit("")}
    line = F.concat(F.lit(" "), T.title(F.col("text")))
    rows = screening(t).join(t("documents").select("doc_id", "text"), "doc_id")
    return rows.select(F.col("doc_id").alias("key"), "decision", *[F.concat(term("doc_id", *x), real.get(name, line)).alias("s" if name == "st" else name) for name, x in MADE.items()])


RISK_SQL = SCREENING_SQL + f""", {RECORDS_SQL}, a as (select key, decision, list_filter([case when decision = 'INCLUDE' and {any_sql('lower(c || reason)', rules.RISK_INTERNAL)} then '{rules.RISK_CATEGORIES[0]}' end,
 case when decision = 'EXCLUDE' and {any_sql('lower(o || reason)', rules.RISK_TRANSFER)} then '{rules.RISK_CATEGORIES[1]}' end, case when decision = 'INCLUDE' and {any_sql('lower(o || reason)', rules.RISK_KNOWLEDGE)} then '{rules.RISK_CATEGORIES[2]}' end,
 case when {any_sql('lower(reason)', rules.RISK_CONTRADICTION)} then '{rules.RISK_CATEGORIES[3]}' end], lambda x: x is not null) as f, left(trim(regexp_replace(c || ' ' || o || ' ' || reason, '\\s+', ' ', 'g')), 500) as context from k)"""


@query(f"with {RISK_SQL} select key, decision, array_to_string(f, ';') as risk_categories, context from a where len(f) > 0")
def q_record_risks(spark, t):
    return gates.rule_audit(records(t))


@query(f"with {RISK_SQL} select unnest(f) as category, count(*) as n from a group by 1")
def q_record_risk_counts(spark, t):
    return progress.count_by(gates.rule_audit(records(t)).select(F.explode(F.split("risk_categories", ";")).alias("category")), "category")


def hits_sql(x: str, terms: list[str]) -> str:
    each = ", ".join(f"{{'t': {quoted(w)}, 'n': {quoted(T.plain(w))}}}" for w in terms)
    return f"list_transform(list_filter([{each}], lambda w: contains({x}, w.n)), lambda w: w.t)"


def picos_sql() -> str:
    parts = []
    for severity, category, where, hit, other, lacks, least in rules.AUDIT_RULES:
        text = "concat_ws(' ', " + ", ".join({"C": "nc", "O": "no", "S": "ns"}[s] for s in where) + ")"
        parts.append(f"select '{severity}' as severity, key as uid, '{category}' as category, array_to_string(list_slice({hits_sql(text, hit)}, 1, 8), ', ') as evidence from h where len({hits_sql(text, hit)}) > 0 and len({hits_sql({'C': 'nc', 'O': 'no', 'S': 'ns'}[other], lacks)}) < {least}")
    return " union all ".join(parts)


NORMAL_SQL = f"n as (select key, {norm_sql('c')} as nc, {norm_sql('o')} as no, {norm_sql('st')} as ns from k)"
ABSENT_SQL = "l as (select doc_id as uid from s where decision = 'INCLUDE'), x as (select l.uid, (select max(1) from documents d where d.doc_id = l.uid and d.doc_id % 6 <> 1 and d.text <> '') as txt, (select max(1) from s where s.doc_id = l.uid and s.doc_id % 9 <> 2) as rec from l)"


@query(f"with {SCREENING_SQL}, {RECORDS_SQL}, {NORMAL_SQL}, {ABSENT_SQL}, h as (select n.* from n join l on l.uid = n.key where n.key % 9 <> 2) {picos_sql()} union all select 'HIGH', uid, 'missing_txt', '' from x where txt is null union all select 'MEDIUM', uid, 'missing_record', '' from x where rec is null")
def q_picos_audit(spark, t):
    """All findings on records: what their sections say, and texts or records that lack."""
    lock = screening(t).filter("decision = 'INCLUDE'").select(F.col("doc_id").alias("uid"))
    texts = t("documents").filter("doc_id % 6 <> 1").select(F.col("doc_id").alias("uid"), "text")
    held = records(t).withColumnRenamed("key", "uid").filter("uid % 9 <> 2")
    return gates.record_audit(lock, texts, held, {"C": F.col("c"), "O": F.col("o"), "S": F.col("s")})


# --- Judgements ------------------------------------------------------------------------------------
#: Evidence of each dimension: a quote of the text, one that is not in it, none, too short a one.
EVIDENCE_SQL = "case ({0} + doc_id) % 5 when 0 then [left(text, 60)] when 1 then ['this sentence is nowhere in the text'] when 2 then [] when 3 then ['short'] else [left(text, 30), 'tiny'] end"


def evidence(n: int):
    text, k = F.col("text"), (F.col("doc_id") + n) % 5
    return F.when(k == 0, F.array(F.left(text, F.lit(60)))).when(k == 1, F.array(F.lit("this sentence is nowhere in the text"))).when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("short"))).otherwise(F.array(F.left(text, F.lit(30)), F.lit("tiny")))


def squeezed_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def dimension_sql(n: int, d: str, result: str) -> str:
    e, r = EVIDENCE_SQL.format(n), result
    parts = [(f"{r} is null", "result missing", True, False), (f"{r} not in ('PASS', 'FAIL', 'UNCERTAIN')", "result invalid", True, False), (f"len({e}) = 0", "evidence missing", True, False), (f"(doc_id + {n}) % 7 = 0", "analysis missing", True, False),
             (f"len(list_filter({e}, lambda x: x <> '' and length(x) < 10)) > 0", "evidence too short", False, False), (f"nt <> '' and len(list_filter({e}, lambda x: length(x) >= 10 and length({squeezed_sql('x')}) >= 20 and not contains(nt, {squeezed_sql('x')}))) > 0", "evidence not in the text", False, True)]
    return " union all ".join(f"select doc_id as key, '{d}: {m}' as issue, {str(s).lower()} as severe, {str(w).lower()} as warning from r where {c}" for c, m, s, w in parts)


JUDGED_SQL = SCREENING_SQL + f""", @D, r as (select j.doc_id, text, {squeezed_sql('text')} as nt, s.decision, case when j.doc_id % 4 = 0 then 'E1' when j.doc_id % 4 = 1 then 'E11' end as code,
 case when j.doc_id % 17 = 0 then 'PASS' else p end as p, case when j.doc_id % 17 = 0 then 'PASS' when j.doc_id % 13 = 0 then null else i end as i, case when j.doc_id % 17 = 0 then 'PASS' when j.doc_id % 11 = 0 then 'bad' else c end as c, case when j.doc_id % 17 = 0 then 'PASS' else o end as o, case when j.doc_id % 17 = 0 then 'PASS' else j.s end as s5 from j join s on s.doc_id = j.doc_id)"""
ALL_OF = lambda x: " and ".join(f"coalesce({d} = '{x}', false)" for d in ("p", "i", "c", "o", "s5"))
ANY_OF = lambda x: "(" + " or ".join(f"coalesce({d} = '{x}', false)" for d in ("p", "i", "c", "o", "s5")) + ")"
QUALITY_SQL = f"""select doc_id as key, 'code invalid' as issue, true as severe, false as warning from r where decision = 'EXCLUDE' and coalesce(code, '') not in ('E1', 'E2', 'E3', 'E4', 'E5', 'E6', 'E7', 'E8', 'E9', 'E10')
 union all select doc_id, 'all pass, not INCLUDE', true, false from r where {ALL_OF('PASS')} and decision <> 'INCLUDE' union all select doc_id, 'a fail, not EXCLUDE', true, false from r where {ANY_OF('FAIL')} and decision <> 'EXCLUDE'
 union all select doc_id, 'uncertain, but INCLUDE', true, false from r where {ANY_OF('UNCERTAIN')} and not {ANY_OF('FAIL')} and decision = 'INCLUDE' union all """ + " union all ".join(dimension_sql(n, d, x) for n, (d, x) in enumerate(zip("PICOS", ("p", "i", "c", "o", "s5"))))


def judgements(t) -> DataFrame:
    """Judgements as a judge answers them, in JSON amid other words, parsed."""
    rows = judged(t).join(screening(t), "doc_id")
    special = F.col("doc_id") % 17 == 0
    change = {"i": F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("i")), "c": F.when(F.col("doc_id") % 11 == 0, "bad").otherwise(F.col("c"))}
    dims = []
    for n, d in enumerate(decisions.DIMENSIONS):
        result = F.when(special, "PASS").otherwise(change.get(d, F.col(d)))
        dims += [F.lit(d.upper()), F.struct(result.alias("result"), evidence(n).alias("evidence"), F.when((F.col("doc_id") + n) % 7 == 0, "").otherwise("because").alias("analysis"))]
    code = F.when(F.col("doc_id") % 4 == 0, "E1").when(F.col("doc_id") % 4 == 1, "E11")
    answer = F.concat(F.lit("Here it is: "), F.to_json(F.struct("decision", code.alias("exclusion_code"), F.create_map(*dims).alias("picos"))), F.lit(" Done."))
    return rows.select(F.col("doc_id").alias("key"), "text", quality.parse(answer).alias("r")).select("key", "text", "r.*")


@query(f"with {JUDGED_SQL} {QUALITY_SQL}")
def q_judgement_issues(spark, t):
    return quality.issues(judgements(t))


@query(f"with {JUDGED_SQL}, q as ({QUALITY_SQL}) select key, count(*) as n_severe from q where severe group by 1")
def q_judgement_retries(spark, t):
    return quality.needs_retry(quality.issues(judgements(t)))


PAPER_SQL = "p as (select doc_id, case doc_id % 4 when 0 then text when 1 then 'Abstract: ' || left(text, 300) || chr(10) || 'Keywords x' when 2 then 'METHODS' || chr(10) || text || chr(10) || 'Results: ' || substr(text, 50, 900) || chr(10) || 'Discussion' else 'Materials and methods ' || left(text, 500) || chr(10) || 'Conclusion' end as t from documents)"
trimmed = lambda x: f"regexp_replace({x}, '^[ \\t\\n\\r\\x0b\\x0c]+|[ \\t\\n\\r\\x0b\\x0c]+$', '', 'g')"
SECTIONS_SQL = PAPER_SQL + ", q as (select doc_id, t, " + ", ".join(f"left({trimmed(f'''regexp_extract(t, '(?is){begin}(.*?){end}', 1)''')}, {most}) as {name}" for name, (begin, end, most) in T.SECTIONS.items()) + " from p)"


@query(f"with {SECTIONS_SQL}, b as (select *, methods || case when results <> '' then chr(10) || chr(10) || results else '' end as both_ from q) select doc_id, md5(abstract) as abstract_md5, md5(methods) as methods_md5, md5(results) as results_md5, md5(case when methods <> '' and length(both_) >= 2000 then both_ else left(t, 8000) end) as content_md5 from b")
def q_paper_sections(spark, t):
    x, n = F.col("text"), F.col("doc_id") % 4
    paper = F.when(n == 0, x).when(n == 1, F.concat(F.lit("Abstract: "), F.left(x, F.lit(300)), F.lit("\nKeywords x"))).when(n == 2, F.concat(F.lit("METHODS\n"), x, F.lit("\nResults: "), F.substring(x, 50, 900), F.lit("\nDiscussion"))).otherwise(F.concat(F.lit("Materials and methods "), F.left(x, F.lit(500)), F.lit("\nConclusion")))
    md5 = lambda c: F.md5(c.cast("binary"))
    rows = t("documents").select("doc_id", paper.alias("t"))
    return rows.select("doc_id", *[md5(T.section_of(F.col("t"), s)).alias(f"{s}_md5") for s in T.SECTIONS], md5(T.judge_content(F.col("t"))).alias("content_md5"))


# --- Binding ---------------------------------------------------------------------------------------
PAPERS_SQL = "p as (select 'k' || doc_id as key, case when doc_id % 10 = 0 then '' else 'Van ' || source || ', X; Other, Y' end as author, cast(2000 + doc_id % 25 as int) as year, split_part(text, chr(10), 1) as title from documents)"
FILES_SQL = "f as (select case when page_id % 5 = 0 then 'K' || page_id || '.pdf' else 'Src' || page_id % 20 || ' - ' || (2000 + page_id % 23) || ' - ' || regexp_replace(left(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), 60), '[./]', '', 'g') || '.pdf' end as file, page_id from pages)"


def papers(t) -> DataFrame:
    author = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.lit("Van "), "source", F.lit(", X; Other, Y")))
    return t("documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), author.alias("author"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), T.title(F.col("text")).alias("title"))


def files(t) -> DataFrame:
    title = F.regexp_replace(F.left(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.lit(60)), "[./]", "")
    name = F.concat(F.lit("Src"), (F.col("page_id") % 20).cast("string"), F.lit(" - "), (2000 + F.col("page_id") % 23).cast("string"), F.lit(" - "), title, F.lit(".pdf"))
    return t("pages").select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("K"), F.col("page_id").cast("string"), F.lit(".pdf"))).otherwise(name).alias("file"), "page_id")


@query(f"""with {PAPERS_SQL}, {FILES_SQL}, n as (select file, lower(regexp_replace(file, '\\.[^.]*$', '')) as stem from f), e as (select key, min(file) as file from p join n on stem = lower(key) group by 1),
 r as (select key, list_extract(string_split_regex(trim(split_part(split_part(lower(author), ',', 1), ';', 1)), '\\s+'), -1) as a, cast(year as varchar) as y, list_slice(list_filter(string_split_regex(left(lower(title), 30), '\\s+'), lambda w: w <> ''), 1, 5) as w from p where key not in (select key from e)),
 h as (select key, min(file) as file from r join n on contains(stem, a) and contains(stem, y) where a <> '' and len(list_filter(w, lambda x: contains(stem, x))) > 0 group by 1)
 select key, file, 'key' as how from e union all select key, file, 'author_year_title' from h""")
def q_file_map(spark, t):
    return binding.file_map(papers(t), files(t).select("file"))


@query()
def q_title_map(spark, t):
    """Papers in the order of key with the most similar file title that is still free, each file once."""
    return binding.title_map(papers(t).select("key", "title"), files(t).select("file"))


@query()
def q_name_score(spark, t):
    """Keys author_year of papers with the five most similar file names."""
    keys = papers(t).filter("author <> ''").select(F.concat(F.split_part("author", F.lit(","), F.lit(1)), F.lit("_"), F.col("year").cast("string")).alias("name")).distinct()
    return binding.name_scores(keys.select(F.col("name").alias("id"), "name"), files(t).select(F.col("page_id").alias("other"), F.col("file").alias("name")))


MAP_SQL = f"{FILES_SQL}, m as (select 'k' || page_id * 5 as key, file, sha256(html) as sha256 from f join pages using (page_id))"


@query(f"with {PAPERS_SQL}, {MAP_SQL}, g as (select sha256 from m where sha256 is not null group by 1 having count(distinct key) > 1) select key, 'unknown key' as problem from m where key not in (select key from p) union all select key, 'file shared' from m join g using (sha256)")
def q_map_problems(spark, t):
    mapping = files(t).join(t("pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256")), "page_id").select(F.concat(F.lit("k"), (F.col("page_id") * 5).cast("string")).alias("key"), "file", "sha256")
    return binding.map_problems(mapping, papers(t))


ACCEPT_SQL = rf"""c as (select doc_id, 'https://doi.org/10.1000/Ab-' || doc_id as doi, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, case when doc_id % 9 = 8 then '' else left(text, 1500) end || case doc_id % 9 when 0 then ' doi 10.1000/ab-' || doc_id when 1 then ' 10.1000AB-' || doc_id when 2 then ' 10.1000 ab ' || doc_id when 8 then '' else ' none' end as first_text from documents join pages on page_id = doc_id),
 k as (select *, '10.1000/ab-' || doc_id as d, lower(first_text) as low, {norm_sql('first_text')} as n, list_filter(list_distinct({tokens_sql('title')}), lambda w: not list_contains({STOP_SQL}, w)) as tk from c),
 v as (select doc_id, contains(low, d) or contains(low, replace(d, '/', '')) or contains(low, replace(replace(d, '/', ' '), '-', ' ')) as doi_ok, cast(len(tk) as int) as n_tokens, case when len(tk) = 0 or n = '' then 0.0::double else len(list_filter(tk, lambda w: contains(n, w)))::double / len(tk) end as title_overlap from k)"""


@query(f"with {ACCEPT_SQL} select *, doi_ok or (n_tokens > 0 and title_overlap >= 0.35) as accepted from v")
def q_candidate_acceptance(spark, t):
    x, k = F.col("text"), F.col("doc_id") % 9
    number = F.col("doc_id").cast("string")
    tail = F.when(k == 0, F.concat(F.lit(" doi 10.1000/ab-"), number)).when(k == 1, F.concat(F.lit(" 10.1000AB-"), number)).when(k == 2, F.concat(F.lit(" 10.1000 ab "), number)).when(k == 8, "").otherwise(" none")
    rows = t("documents").join(t("pages"), F.col("page_id") == F.col("doc_id")).select("doc_id", F.concat(F.lit("https://doi.org/10.1000/Ab-"), number).alias("doi"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.concat(F.when(k == 8, "").otherwise(F.left(x, F.lit(1500))), tail).alias("first_text"))
    return binding.acceptance(rows).select("doc_id", "doi_ok", "n_tokens", "title_overlap", "accepted")


@query("""with c as (select conv_id as key, cast(turn as int) as place, role || turn as file from conversations where conv_id % 7 <> 3), h as (select distinct conv_id as key, cast(conv_id % 9 as int) as choice from conversations)
 select h.key, case when choice <> 0 then file end as file, case when choice = 0 then 'skipped' when h.key not in (select key from c) then 'no candidates' when file is null then 'no such number' else 'applied' end as status from h left join c on c.key = h.key and c.place = h.choice""")
def q_apply_choices(spark, t):
    talk = t("conversations")
    candidates = talk.filter("conv_id % 7 <> 3").select(F.col("conv_id").alias("key"), F.col("turn").cast("int").alias("place"), F.concat("role", F.col("turn").cast("string")).alias("file"))
    return binding.apply_choices(talk.select(F.col("conv_id").alias("key"), (F.col("conv_id") % 9).cast("int").alias("choice")).distinct(), candidates)


# --- Locks, guards, reconciliation -----------------------------------------------------------------
@query(rf"""with l as (select case when doc_id % 31 = 0 then '' else 'u' || doc_id end as uid, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, '10.1000/ab-' || doc_id as doi, case when doc_id % 23 = 0 then '' when doc_id % 19 = 0 then 'none' else 'f' || doc_id end as path, case when doc_id % 17 = 0 then 'X' else upper(sha256(text)) end as sha256 from documents join pages on page_id = doc_id),
 f as (select 'f' || doc_id as path, sha256(text) as actual, left(text, 900) || case when doc_id % 2 = 0 then ' 10.1000 ab ' || doc_id else '' end as first_text from documents), n as (select * from l where uid <> ''), h as (select n.*, actual, first_text, f.path is not null as there from n left join f on f.path = n.path),
 k as (select *, {norm_sql('first_text')} as nt, list_filter(list_distinct({tokens_sql('title')}), lambda w: not list_contains({STOP_SQL}, w)) as tk, lower(first_text) as low from h where there)
 select 'FAIL' as severity, 'lock' as scope, uid, 'uid missing' as message, '' as evidence from l where uid = '' union all select 'FAIL', 'lock', uid, 'path missing', '' from n where path = '' union all select 'FAIL', 'file', uid, 'file missing', path from h where path <> '' and not there
 union all select 'FAIL', 'file', uid, 'sha256 differs', actual from h where there and lower(sha256) <> actual union all select 'WARN', 'file', uid, 'doi not found', doi from k where not (contains(low, doi) or contains(low, replace(doi, '/', '')) or contains(low, replace(replace(doi, '/', ' '), '-', ' ')))
 union all select 'WARN', 'file', uid, 'title overlap low', cast(len(tk) as varchar) from k where len(tk) > 0 and len(list_filter(tk, lambda w: contains(nt, w)))::double / len(tk) < 0.35""")
def q_lock_contents(spark, t):
    docs, number, d = t("documents"), F.col("doc_id").cast("string"), F.col("doc_id")
    lock = docs.join(t("pages"), F.col("page_id") == d).select(F.when(d % 31 == 0, "").otherwise(F.concat(F.lit("u"), number)).alias("uid"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.concat(F.lit("10.1000/ab-"), number).alias("doi"),
        F.when(d % 23 == 0, "").when(d % 19 == 0, "none").otherwise(F.concat(F.lit("f"), number)).alias("path"), F.when(d % 17 == 0, "X").otherwise(F.upper(F.sha2(F.col("text").cast("binary"), 256))).alias("sha256"))
    held = docs.select(F.concat(F.lit("f"), number).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.concat(F.left("text", F.lit(900)), F.when(d % 2 == 0, F.concat(F.lit(" 10.1000 ab "), number)).otherwise("")).alias("first_text"))
    return gates.lock_contents(lock, held, blank=True)


@query("""with l as (select doc_id as uid from documents where doc_id % 3 <> 0), i as (select doc_id as uid from documents where doc_id % 10 = 0), x as (select doc_id as uid from documents where doc_id % 15 = 1)
 select 'FAIL' as severity, 'lock' as scope, cast(uid as varchar) as uid, 'included by administrator, not locked' as message, '' as evidence from i where uid not in (select uid from l) union all select 'FAIL', 'lock', cast(uid as varchar), 'excluded by administrator, still locked', '' from x where uid in (select uid from l)""")
def q_admin_lists(spark, t):
    uid = t("documents").select(F.col("doc_id").alias("uid"))
    return gates.admin_lists(uid.filter("uid % 3 <> 0"), uid.filter("uid % 10 = 0"), uid.filter("uid % 15 = 1"))


#: Excluded uids: pages of excluded documents, and two words that texts hold.
EXCLUDED_SQL = SCREENING_SQL + ", x as (select 'page' || doc_id as u from s where decision = 'EXCLUDE' union select 'token' union select 'example.com')"
PATHS_SQL = "case when page_id % 3 = 0 then '/p4/t' || page_id || '.tsv' when page_id % 3 = 1 then '/rob/page' || page_id || '.json' else '/rob/_excluded/page' || page_id || '.json' end"


@query(f"with {EXCLUDED_SQL}, f as (select {PATHS_SQL} as path, html as text from pages), w as (select path, case when ends_with(path, '.tsv') then text when not contains(path, '_excluded') then regexp_extract(path, '[^/]+$') else '' end as w from f) select 'FAIL' as severity, 'downstream' as scope, u as uid, 'excluded uid downstream' as message, path as evidence from w, x where contains(w, u)")
def q_downstream(spark, t):
    words = spark.createDataFrame([("token",), ("example.com",)], "uid string")
    excluded = screening(t).filter("decision = 'EXCLUDE'").select(F.concat(F.lit("page"), F.col("doc_id").cast("string")).alias("uid")).unionByName(words)
    k, number = F.col("page_id") % 3, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/p4/t"), number, F.lit(".tsv"))).when(k == 1, F.concat(F.lit("/rob/page"), number, F.lit(".json"))).otherwise(F.concat(F.lit("/rob/_excluded/page"), number, F.lit(".json")))
    return gates.downstream(t("pages").select(path.alias("path"), F.col("html").alias("text")), excluded)


@query("""select * from (select 'tables' as "check", false as ok, 'progress' as evidence union all select 'papers', (select count(*) from documents) > 0, cast((select count(*) from documents) as varchar) union all select 'screening', (select count(*) from labels) <= (select count(*) from documents), cast((select count(*) from labels) as varchar))""")
def q_database_guard(spark, t):
    return gates.database_guard(["papers", "screening"], ["papers", "screening", "progress"], t("documents"), t("labels"))


STATE_SQL = SCREENING_SQL + ", d as (select doc_id as key from s where doc_id % 13 <> 0), f as (select doc_id as key, decision from s where doc_id % 11 <> 0)"


def state(t) -> tuple[DataFrame, DataFrame]:
    rows = screening(t).withColumnRenamed("doc_id", "key")
    return rows.filter("key % 13 <> 0").select("key"), rows.filter("key % 11 <> 0")


@query(f"with {STATE_SQL} select coalesce(d.key, f.key) as key, case when d.key is null then 'unmarked' when f.key is null then 'missing' else 'ok' end as status, decision from d full join f on d.key = f.key")
def q_state_repair(spark, t):
    return progress.reconcile(*state(t))


@query(f"with {STATE_SQL}, e as (select decision, count(*) as n from s group by 1) select x.decision, coalesce(n, 0) as expected, count(f.key) as actual, coalesce(n, 0) = count(f.key) as ok from (select unnest(['INCLUDE', 'EXCLUDE', 'MAYBE', 'SKIPPED']) as decision) x left join e on e.decision = x.decision left join f on f.decision = x.decision group by x.decision, n")
def q_state_recount(spark, t):
    return progress.recount(progress.count_by(screening(t), "decision"), state(t)[1], ["INCLUDE", "EXCLUDE", "MAYBE", "SKIPPED"])


@query("with o as (select doc_id as key, doc_id % 5 as v from documents where doc_id < 100), n as (select doc_id % 150 as key, doc_id as v from documents), x as (select key, max(v) as v from n group by 1) select * from x union all select * from o where key not in (select key from x)")
def q_upsert(spark, t):
    d = F.col("doc_id")
    old = t("documents").filter("doc_id < 100").select(d.alias("key"), (d % 5).alias("v"))
    return progress.last_wins(old, t("documents").select((d % 150).alias("key"), d.alias("v")), "key", "v")


PATH_SQL = "case when s.doc_id % 4 = 0 then null when s.doc_id % 4 = 1 then '' else 'p' || s.doc_id end"


@query(f"with @S select s.doc_id from s where decision = 'INCLUDE' and ({PATH_SQL} is null or {PATH_SQL} = '')")
def q_missing_path(spark, t):
    path = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "").otherwise(F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    return progress.missing_path(screening(t).withColumn("path", path)).select("doc_id")


ODD_SQL = "p as (select doc_id, case doc_id % 4 when 0 then '' when 1 then null else source end as author, cast(case when doc_id % 8 < 6 then 0 else 2020 end as int) as year, case when doc_id % 3 = 0 then '' else split_part(text, chr(10), 1) end as title from documents)"


@query(f"with {ODD_SQL} select doc_id, case when author = '' and year = 0 and title = '' then 'invalid' when not (author = '' and year = 0 and title = '') then 'valid' else 'neither' end as kind from p where doc_id not in (select doc_id from labels)")
def q_invalid_papers(spark, t):
    """Left to screen: invalid, valid, or neither, where a null decides nothing."""
    d = F.col("doc_id")
    rows = t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", F.when(d % 4 == 0, "").when(d % 4 == 1, None).otherwise(F.col("source")).alias("author"), F.when(d % 8 < 6, 0).otherwise(2020).alias("year"), F.when(d % 3 == 0, "").otherwise(T.title(F.col("text"))).alias("title"))
    bad = progress.invalid_paper()
    return rows.select("doc_id", F.when(bad, "invalid").when(~bad, "valid").otherwise("neither").alias("kind"))


@query("select doc_id, lang, source from documents where doc_id = 7")
def q_find(spark, t):
    return progress.find(t("documents"), "doc_id", 7).select("doc_id", "lang", "source")


# --- Runs, samples, reports ------------------------------------------------------------------------
RESUME_SQL = f"""r as (select user_id as run, count(*) as total_calls, count(*) filter (where event_type <> 'error') as completed_calls, case when user_id % 9 = 4 then null else datesub('second', max(ts), timestamp '{NOW}') end as age_seconds, max(event_id) as m, user_id % 2 = 0 as can_resume from events group by user_id),
 q as (select *, case when total_calls > 0 and completed_calls >= total_calls then 'completed' when age_seconds is null then 'unknown' when age_seconds > 600 then 'stale' else 'running_or_recent' end as status from r)"""


@query(f"""with {RESUME_SQL} select run, status, case status when 'completed' then 'completed' when 'unknown' then 'no_runtime_signal' when 'stale' then 'possibly_interrupted' else 'recent_heartbeat' end as health, cast(floor(round(100 * completed_calls::double / total_calls, 1)) as int) as percent,
 coalesce(run % 3 <> 0 and status = 'stale' and can_resume and age_seconds is not null and age_seconds >= 3600 and not run % 5 = 0 and not run % 7 = 0 and m % 400 >= 180 and completed_calls < total_calls, false) as resume from q""")
def q_auto_resume(spark, t):
    run = F.col("run")
    age = F.when(run % 9 != 4, F.timestamp_diff("SECOND", F.max("ts"), F.lit(NOW).cast("timestamp_ntz")).cast("long"))
    rows = events(t).groupBy("run").agg(F.count("*").alias("total_calls"), F.count_if(F.col("state") != "error").alias("completed_calls"), age.alias("age_seconds"), F.max("event_id").alias("m"))
    rows = rows.withColumn("can_resume", run % 2 == 0).withColumn("auto_resume", run % 3 != 0).withColumn("child_running", run % 5 == 0).withColumn("resume_running", run % 7 == 0).withColumn("since_launch", F.col("m") % 400)
    out = runs.should_resume(runs.call_status(rows), stale_seconds=3600)
    return out.select("run", "status", "health", F.floor("percent").cast("int").alias("percent"), "resume")


@query("""with e as (select user_id as run, max(event_id) as m from events group by 1), c as (select conv_id as run, max(turn) as m from conversations group by 1), b as (select coalesce(e.run, c.run) as run, case when e.run is not null and c.run is not null then 'PAIRED' else 'UNPAIRED' end as pairing, greatest(e.m, c.m) as newest from e full join c on e.run = c.run)
 select run, pairing, newest as "at" from b order by case when pairing = 'PAIRED' then 0 else 1 end, newest desc, run desc limit 1""")
def q_newest_pair(spark, t):
    return runs.newest_pair(t("events").groupBy(F.col("user_id").alias("run")).agg(F.max("event_id").alias("at")), t("conversations").groupBy(F.col("conv_id").alias("run")).agg(F.max("turn").alias("at")))


@query("with @S, r as (select *, row_number() over (partition by decision order by md5('7|' || cast(doc_id as varchar)), doc_id) as k, count(*) over (partition by decision) as n from s where decision in ('INCLUDE', 'EXCLUDE')) select doc_id, decision from r where k <= least(n, greatest(1, floor(n * case when decision = 'INCLUDE' then 0.1::double else 0.05::double end)))")
def q_review_sample(spark, t):
    return runs.review_sample(screening(t), "doc_id", "7")


AT = "cast(timestamp '2024-01-01 10:00:00' + interval (doc_id % 40) day as timestamp)"


def timed(t) -> DataFrame:
    return screening(t).withColumn("at", F.timestamp_add("DAY", (F.col("doc_id") % 40).cast("int"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")))


@query(f"with @S, d as (select count(*) as processed, count(distinct cast({AT} as date)) as days from s), l as (select count(*) as remaining from documents where doc_id not in (select doc_id from s)) select processed, days, remaining, processed::double / days as daily_average, case when remaining > 0 then remaining / (processed::double / days) end as eta_days from d, l")
def q_efficiency(spark, t):
    return progress.efficiency(timed(t), t("documents").join(screening(t), "doc_id", "left_anti"))


@query("""with @S, r as (select doc_id, case when doc_id % 2 = 0 then 'resolve' else 'confirm' end as action from s where doc_id % 5 < 3) select count(*) filter (where action = 'resolve') as resolved, count(*) filter (where action = 'confirm') as confirmed,
 (select count(*) from s where decision = 'MAYBE' and doc_id not in (select doc_id from r where action = 'resolve')) as pending_maybe from r""")
def q_qa_status(spark, t):
    reviews = screening(t).filter("doc_id % 5 < 3").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "resolve").otherwise("confirm").alias("action"))
    return progress.qa_status(reviews.unionByName(reviews), screening(t), "doc_id")


REPORT_SQL = SCREENING_SQL + f""", @D, p as (select doc_id as key, split_part(text, chr(10), 1) as title, cast(case when doc_id % 30 = 0 then 0 else 2000 + doc_id % 25 end as int) as year, case when doc_id % 4 = 0 then null else 'x' end as path from documents),
 c as (select s.doc_id as key, case when s.doc_id % 37 = 0 then 'SKIPPED' else decision end as decision, case when s.doc_id % 3 = 0 then 'E1' end as code, {AT.replace('doc_id', 's.doc_id')} as done_at, j.p, j.i, j.c, j.o, j.s as s5 from s join j on j.doc_id = s.doc_id), b as (select * from p join c using (key)),
 n as (select (select count(*) from p) as total, (select count(*) from c) as processed, (select count(*) from p where key not in (select key from c)) as remaining), u as (unpivot (select p, i, c, o, s5 as s from c where decision = 'INCLUDE') on p, i, c, o, s into name dim value result)
 select 'overview' as section, 'total' as item, cast(total as varchar) as value from n union all select 'overview', 'processed', cast(processed as varchar) from n union all select 'overview', 'remaining', cast(remaining as varchar) from n union all select 'overview', 'status', case when total = 0 then 'idle' when remaining = 0 then 'done' else 'running' end from n
 union all select 'overview', lower(d) || '_count', cast((select count(*) from c where decision = d) as varchar) from (select unnest(['INCLUDE', 'EXCLUDE', 'MAYBE', 'SKIPPED']) as d) union all select 'years', cast(year as varchar), cast(count(*) as varchar) from b where decision = 'INCLUDE' and year > 0 group by year
 union all select 'exclusions', coalesce(code, 'UNKNOWN'), cast(count(*) as varchar) from c where decision = 'EXCLUDE' group by 2 union all select 'dimensions', dim || ' ' || result, cast(count(*) as varchar) from u group by dim, result
 union all select * from (select 'attention', cast(key as varchar), 'no document' from b where decision = 'INCLUDE' and (path is null or path = '') order by key limit 20) union all select 'attention', 'count', cast(count(*) as varchar) from b where decision = 'INCLUDE' and (path is null or path = '')
 union all select * from (select 'skipped', cast(key as varchar), title from b where decision = 'SKIPPED' order by key limit 20) union all select 'skipped', 'count', cast(count(*) as varchar) from b where decision = 'SKIPPED'
 union all select 'efficiency', 'processed', cast(processed as varchar) from n union all select 'efficiency', 'remaining', cast(remaining as varchar) from n union all select 'efficiency', 'days', cast(count(distinct cast(done_at as date)) as varchar) from c"""


@query(f"with {REPORT_SQL}")
def q_report(spark, t):
    d = F.col("doc_id")
    mine = t("documents").select(d.alias("key"), T.title(F.col("text")).alias("title"), F.when(d % 30 == 0, 0).otherwise(2000 + d % 25).cast("int").alias("year"), F.when(d % 4 != 0, "x").alias("path"))
    done = timed(t).join(judged(t).select("doc_id", *decisions.DIMENSIONS), "doc_id").select(d.alias("key"), F.when(d % 37 == 0, "SKIPPED").otherwise(F.col("decision")).alias("decision"), F.when(d % 3 == 0, "E1").alias("code"), "at", *decisions.DIMENSIONS)
    return reports.summary(mine, done)
