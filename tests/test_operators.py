"""Hand-written cases of the operators, from the formats and rules that they state."""

import difflib
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamis.functions import rules
from tamis.functions import text as T
from tamis.operators import binding, decisions, gates, judging, likeness, limiter, matching, progress, quality, reports, runs, terms


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


CASES = [  # p i c o s, c text, o text, decision, code, path -> derived, after the gate
    ("PPPPP", "", "", "INCLUDE", None, ("INCLUDE", None), "INCLUDE"),
    ("PPPPP", "", "", "EXCLUDE", "E1", ("INCLUDE", None), "MAYBE"),
    ("FPPPP", "", "", "EXCLUDE", "E1", ("EXCLUDE", "E1"), "EXCLUDE"),
    ("FPPPP", "", "", "EXCLUDE", "E2", ("EXCLUDE", "E1"), "MAYBE"),
    ("PPFFP", "", "", "EXCLUDE", "E4", ("EXCLUDE", "E4"), "EXCLUDE"),
    ("PPPFP", "", "Written test", "EXCLUDE", "E3", ("EXCLUDE", "E3"), "EXCLUDE"),
    ("PPFPP", "HMD vs desktop", "", "EXCLUDE", "E10", ("EXCLUDE", "E10"), "EXCLUDE"),
    ("PPFPP", "plain", "", "EXCLUDE", "E5", ("EXCLUDE", "E5"), "EXCLUDE"),
    ("PPPPP", "novice surgeons", "", "INCLUDE", None, ("INCLUDE", None), "MAYBE"),
    ("PPPPP", "", "MCQ only", "INCLUDE", None, ("INCLUDE", None), "MAYBE"),
    ("PPPPP", "", "MCQ and OSATS", "INCLUDE", None, ("INCLUDE", None), "INCLUDE"),
    ("PPPFP", "", "follow-up of six", "EXCLUDE", "E4", ("EXCLUDE", "E4"), "MAYBE"),
    ("PPPFP", "", "no retention", "EXCLUDE", "E4", ("EXCLUDE", "E4"), "EXCLUDE"),
    ("PPUPP", "", "", "MAYBE", None, ("MAYBE", None), "MAYBE"),
    ("PP?PP", "", "", "INCLUDE", None, (None, None), "INCLUDE"),
    ("✅P❌PP", "plain", "", "EXCLUDE", "E5", ("EXCLUDE", "E5"), "EXCLUDE"),
]


def test_derivation_and_gate(spark):
    names = {"P": "PASS", "F": "FAIL", "U": "UNCERTAIN", "?": None}
    data = [(i, *[names.get(x, x) for x in c[0]], *c[1:5]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(data, "id int, p string, i string, c string, o string, s string, ct string, ot string, decision string, code string")
    out = decisions.hard_gate(decisions.derive(df, F.col("ct"), F.col("ot")), F.col("ct"), F.col("ot")).orderBy("id").collect()
    for r, c in zip(out, CASES):
        assert (r.derived_decision, r.derived_code) == c[5], c
        assert r.final_decision == c[6] and (r.final_code is None or c[6] == "EXCLUDE"), (c, r)


def test_validation(spark):
    df = spark.createDataFrame([(1, "INCLUDE", None, " ", "PASS", "PASS", "PASS", "PASS", None), (2, "EXCLUDE", "E11", "x", *["FAIL"] * 5), (3, "ERROR", None, "x", *["PASS"] * 5), (4, "MAYBE", None, None, *["⚠️"] * 5)], "key int, decision string, code string, path string, p string, i string, c string, o string, s string")
    got = {(r.key, r.issue) for r in decisions.validate(df).collect()}
    assert got == {(1, "include without document"), (1, "s: invalid result"), (2, "invalid code"), (3, "invalid decision")}


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.normalize_doi(lit(" https://DX.doi.org/10.1/AB.,;) "))) == "10.1/ab"
    assert one(spark, T.normalize(lit("A–b  C_d 中文!"))) == "a b c d 中文"
    assert sorted(one(spark, T.title_tokens(lit("The Effects of virtual Reality on knee knee surgery")))) == ["knee", "surgery"]
    assert one(spark, T.overlap(F.array().cast("array<string>"), lit("x"))) == 1.0
    assert one(spark, T.squeeze(lit("a \t b \r\n\r\n\n\n c"))) == "a b\n\n c"
    assert one(spark, T.nfkc(lit("ﬁ ２"))) == "fi 2"
    assert one(spark, T.unreadable_ratio(lit("a" * 90 + "§" * 10))) == pytest.approx(0.1) and one(spark, T.unreadable_ratio(lit("short"))) == 1.0
    assert one(spark, T.redact(lit("key sk-abcdefgh12 bearer a.b-c\nme@x.org"), 30)) == "key sk-*** Bearer *** ***@***"
    assert [one(spark, T.year(lit(x))) for x in ("2024/05/01", "in press", "12345")] == [2024, 0, 1234]
    assert one(spark, T.control_characters(lit("a\x02b\x1f\n\tc\x02"))) == ["02", "1f"]
    assert one(spark, T.contains_any(lit("p 005 found"), ["re:p 0+5", "re:^x", "found"])) == ["re:p 0+5", "found"]
    assert one(spark, T.make_key(lit("Chen"), lit(2026), lit("  Some Title of more than thirty characters"))) == "Chen_2026_" + hashlib.md5(b"some title of more than thirty").hexdigest()[:6]
    assert one(spark, T.section_of(lit("Abstract: x\ny\nKeywords z"), "abstract")) == "x\ny" and one(spark, T.judge_content(lit("no sections"), 4)) == "no s"
    assert str(one(spark, T.iso_time(lit("2026-01-02T03:04:05Z")))) == "2026-01-02 03:04:05" and one(spark, T.iso_time(lit("soon"))) is None
    assert one(spark, T.contains_any(lit("no control group here"), ["single-arm", "control group", "No control group"])) == ["control group", "No control group"]
    assert one(spark, T.parse_object(lit('noise {"k": 4} tail'), "k int")).k == 4
    assert len(one(spark, T.fingerprint(lit(None), lit("r")))) == 16 and T.plain("Known-Groups,  中文") == "known groups 中文"


def test_first_rule(spark):
    titles = {"A systematic  review of x": 1, "Recent advances in y": 9, "Knee: an update": 12 + 13, "On VR 系统综述": 12 + 28, "Plain title": None}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {r.t: r.hit and r.hit.rule_id for r in df.select("t", matching.first_rule(F.col("t"), rules.REVIEW_PATTERNS, rules.REVIEW_KEYWORDS).alias("hit")).collect()}
    assert got == titles and len(rules.REVIEW_PATTERNS) == 12 and len(rules.REVIEW_KEYWORDS) == 35


def test_audit_rules(spark):
    df = spark.createDataFrame([
        ("u1", "novice group", "score and accuracy", "randomized"), ("u2", "novice group; control group", "", ""), ("u3", "single-arm", "satisfaction", "pilot study"),
        ("u4", "HMD vs desktop", "MCQ, OSATS, checklist", "pilot study, randomised"), ("u5", "", "same day", ""), ("u6", None, "same day, 3 months", None),
    ], "uid string, c string, o string, s string")
    got = {(r.uid, r.severity, r.category) for r in gates.audit_findings(df, "uid", {"C": F.col("c"), "O": F.col("o"), "S": F.col("s")}).collect()}
    assert got == {("u1", "HIGH", "experience_comparator"), ("u3", "HIGH", "no_control"), ("u3", "MEDIUM", "self_report"), ("u3", "MEDIUM", "design_risk"), ("u4", "HIGH", "internal_comparator"), ("u5", "MEDIUM", "immediate_only")}


def test_lock_checks_and_gate(spark):
    lock = spark.createDataFrame([("a", "Some long title words", "1"), ("b", "Other\x02 heading entirely", "2"), ("b", "x", "2"), (None, "none", "3"), ("c", "missing", "4")], "uid string, title string, sha256 string")
    assets = spark.createDataFrame([("a", "some LONG title of words", "1"), ("b", "nothing alike", "9")], "uid string, title string, sha256 string")
    issues = gates.lock_issues(lock, assets)
    got = sorted((r.uid or "", r.message) for r in issues.collect())
    assert ("b", "uid repeated") in got and ("b", "control characters") in got and ("", "uid missing") in got and ("c", "asset missing") in got
    assert got.count(("b", "sha256 differs")) == 2 and ("b", "title overlap low") in got and not any(u == "a" for u, _ in got)
    before = gates.gate(issues.filter("severity = 'WARN'")).first()
    assert before.passed and not gates.gate(issues).first().passed
    db = spark.createDataFrame([("a", "EXCLUDE"), ("x", "INCLUDE"), ("y", "INCLUDE")], "uid string, decision string")
    got = {(r.severity, r.uid) for r in gates.lock_vs_database(lock, db, spark.createDataFrame([("y",)], "uid string")).collect()}
    assert got == {("WARN", "a"), ("WARN", "x"), ("FAIL", "y")}


def test_progress_and_queue(spark):
    papers = spark.createDataFrame([(1, "a"), (2, ""), (3, "c"), (4, None)], "key int, author string")
    screened = spark.createDataFrame([(3, "ERROR")], "key int, decision string")
    row = progress.progress(papers, screened, "key").first()
    assert (row.total, row.processed, row.remaining, row.error_count, row.status) == (4, 1, 3, 1, "running")
    assert progress.progress(papers.limit(0), screened.limit(0), "key").first().status == "idle"
    assert progress.progress(papers.filter("key = 3"), screened, "key", "done").first().status == "done"
    # three-valued logic: a null author is neither invalid nor schedulable
    assert [r.key for r in progress.work_queue(papers, screened, "key", ~(F.col("author") == "")).collect()] == [1]
    new = spark.createDataFrame([(4, "d", 1), (5, "e", 2), (5, "f", 3)], "key int, author string, pos int")
    assert [(r.key, r.author) for r in progress.first_wins(papers, new, "key", "pos").collect()] == [(5, "e")]
    assert sorted((r.key, r.author) for r in progress.last_wins(papers, new, "key", "pos").collect() if r.key > 3) == [(4, "d"), (5, "f")]
    values = spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)], "g string, v int")
    assert progress.upper_median(values, "g", "v").first().upper_median == 3


@pytest.mark.parametrize("rate,least", [(0.1, 1), (0.5, 3), (1.0, 1), (0.0, 2)])
def test_sample_sizes_and_repeats(spark, rate, least):
    import math

    df = spark.range(200).select("id", (F.col("id") % 7 % 3).alias("g"))
    got = runs.stratified_sample(df, "g", "id", rate, least, "s")
    want = {r.g: min(r["count"], max(least, math.ceil(r["count"] * rate))) for r in df.groupBy("g").count().collect()}
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == want
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in runs.stratified_sample(df.repartition(3), "g", "id", rate, least, "s").collect())


def test_quotes_against_all_pairs(spark):
    docs = [(1, "Alpha beta gamma delta, epsilon!"), (2, "alphabet betamax gammaray deltawing"), (3, "none of it"), (4, ""), (5, None)]
    docs += [(6, "Alpha beta gamma delta, epsilon!"), (7, "x beta gamma"), (8, "gamma gamma delta beta alphas")]
    quotes = [(1, "alpha BETA gamma delta"), (2, "beta"), (3, "of it"), (4, "..."), (5, "zeta alpha theta"), (6, "beta beta beta gamma nowhere"), (7, "eta ga"), (8, "a"), (9, "nowhere to be"), (10, "ta gamma delta")]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, text string")
    norm = lambda t: T.plain(t or "")
    exact = {(i, j) for i, a in quotes for j, b in docs if norm(a) and norm(a) in norm(b)}
    assert {(r.item_id, r.doc_id) for r in terms.quotes_in(d, q).collect()} == exact
    tokens = {i: [x for x in norm(a).split() if len(x) >= 4] for i, a in quotes}
    near = {(i, j) for i, tk in tokens.items() for j, b in docs if tk and sum(x in norm(b) for x in tk) >= 0.72 * len(tk)}
    assert {(r.item_id, r.doc_id) for r in terms.overlapping(d, q).collect()} == near and near - exact


def test_fuzzy_names(spark):
    left = spark.createDataFrame([(1, "Training of surgeons"), (2, "laparoscopy")], "id int, name string")
    right = spark.createDataFrame([(10, "surgeons training of"), (11, "Training of surgeons and more"), (12, "surgeons"), (13, "laparoscopy today")], "other int, name string")
    got = {(r.id, r.other): r.score for r in matching.best_matches(left, right).collect()}
    assert got[1, 11] == got[2, 13] == 0.95
    assert got[1, 10] == pytest.approx(difflib.SequenceMatcher(None, "training of surgeons", "surgeons training of").ratio())
    assert {(r.id, r.other) for r in matching.mutual_best(matching.best_matches(left, right)).collect()} == {(1, 11), (2, 13)}


def test_fuzzy_names_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "NAMES_LEFT", 9)
    monkeypatch.setattr(matching, "NAMES_RIGHT", 13)
    rnd = random.Random(5)
    words = ["laparoscopy", "training", "of", "a", "box", "surgeons", "vr", "knots", "12"]
    name = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 5)))
    mine = [(i, name()) for i in range(40)] + [(90, "Laparoscopi training"), (91, "vr a"), (92, ""), (93, None), (94, "中文 标题")]
    theirs = [(i, name()) for i in range(70)] + [(700, "Training of laparoscopy"), (701, "vr"), (702, None), (703, "中文"), (704, "vr")]
    got = {(r.id, r.place): (r.other, r.score) for r in matching.best_matches(spark.createDataFrame(mine, "id int, name string"), spark.createDataFrame(theirs, "other int, name string")).collect()}
    want = {}
    for i, x in mine:
        a, pairs = T.plain(x or ""), []
        for j, y in theirs:
            if a and (b := T.plain(y or "")):
                pairs.append((0.95 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio(), j))
        pairs = sorted((p for p in pairs if p[0] >= 0.3), key=lambda p: (-p[0], p[1]))[:5]
        want |= {(i, k): (j, pytest.approx(s)) for k, (s, j) in enumerate(pairs, 1)}
    assert got == want and (90, 1) in got and (91, 1) in got


def test_fuzzy_names_meet_without_copies(spark, monkeypatch):
    """Blocks meet in a Cartesian product: no name is written once for each block of the other side."""
    monkeypatch.setattr(matching, "NAMES_LEFT", 2)
    monkeypatch.setattr(matching, "NAMES_RIGHT", 3)
    mine, theirs = (spark.range(40).selectExpr(f"cast(id as int) as {who}", "concat('knots of ', id) as name") for who in ("id", "other"))
    got = matching.best_matches(mine, theirs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and got._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 1
    assert {r.id: r.other for r in got.filter("place = 1").collect()}.keys() == set(range(40))


def test_judges(spark):
    docs = spark.createDataFrame([(1, "x" * 300), (2, None), (3, "licensed under " + "y" * 300)], "doc_id long, text string")
    got = {r.doc_id: (r.p, r.c, r.reason) for r in judging.judge_all(docs, judging.RuleJudge()).collect()}
    assert got == {1: ("PASS", "PASS", ""), 2: ("UNCERTAIN", "UNCERTAIN", "too short"), 3: ("PASS", "FAIL", "")}

    class Broken:
        def judge(self, batch):
            raise KeyError("no backend")

    assert {r.reason for r in judging.judge_all(docs, Broken()).collect()} == {"judge failed: KeyError"}
    assert [r.wait_seconds for r in judging.attempts(docs.filter("doc_id = 1")).orderBy("attempt").collect()] == [0, 30, 60]


def test_terms_against_contains(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choices("abc \u4e2d", k=rnd.randrange(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (901, "ab"), (None, "abc")]
    words = sorted({"".join(rnd.choices("abc \u4e2d", k=rnd.randrange(1, 5))) for _ in range(120)})
    listed = [(f"u{i}", w) for i, w in enumerate(words)] + [("again", words[0]), ("none", ""), ("null", None), ("again", words[0])]
    df, known = spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(listed, "term_id string, term string")
    want = sorted((str(k), i) for k, t in texts for i, w in set(listed) if w and t and w in t)
    assert sorted((str(r.key), r.term_id) for r in terms.found_terms(df, known).collect()) == want
    monkeypatch.setattr(terms, "MOST_TERMS", 17)  # several automata
    assert sorted((str(r.key), r.term_id) for r in terms.found_terms(df, known).collect()) == want
    assert terms.found_terms(df, known.limit(0)).count() == terms.found_terms(df.limit(0), known).count() == 0
    many = spark.range(100_000).selectExpr("cast(id as string) as term_id", "concat('w', lpad(id, 6, '0')) as term")
    monkeypatch.undo()
    found = terms.found_terms(spark.createDataFrame([(1, "w000007w099999 w1"), (2, "x")], "key long, text string"), many).collect()
    assert sorted((r.key, r.term_id) for r in found) == [(1, "7"), (1, "99999")]


def test_downstream_and_absent_artifacts(spark):
    files = spark.createDataFrame([("/a/x.tsv", "u1 and u22"), ("/a/u1.json", "u22"), ("/a/_excluded/u1.json", ""), ("/q/Quarantine/u1.json", ""), ("/a/x.txt", "u1"), ("/a/y.tsv", None)], "path string, text string")
    excluded = spark.createDataFrame([("u1",), ("u2",), ("",), ("u1",)], "uid string")
    assert sorted((r.uid, r.evidence) for r in gates.downstream(files, excluded).collect()) == [("u1", "/a/u1.json"), ("u1", "/a/x.tsv"), ("u2", "/a/x.tsv")]
    lock = spark.createDataFrame([(1,), (2,), (3,), (3,)], "uid long")
    texts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "")], "uid long, text string")
    records = spark.createDataFrame([(1, "no control group"), (2, "no control group"), (9, "no control group")], "uid long, c string")
    rule = [("HIGH", "no_control", "C", ["no control group"], "C", ["desktop"], 1)]
    got = gates.record_audit(lock, texts, records, {"C": F.col("c")}, rule)
    assert sorted((r.uid, r.category) for r in got.collect()) == [(1, "no_control"), (2, "missing_txt"), (2, "no_control"), (3, "missing_record"), (3, "missing_txt")]


def test_binding(spark):
    papers = spark.createDataFrame([("k1", "De La Garza, M; X", 2019, "A trial of knots"), ("k2", "Wang, L", 2020, "Virtual training of residents"), ("k3", "", 2020, "Virtual"), ("K4", "Zapf", 2013, "Other"), ("k5", "Wang", 2020, "Nothing alike")], "key string, author string, year int, title string")
    names = ["K1.pdf", "b wang 2020 virtual.pdf", "a wang 2020 virtual.pdf", "zapf 2013.pdf", "wang 12020 nothing.pdf"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    got = {r.key: (r.file, r.how) for r in binding.file_map(papers, files).collect()}
    assert got == {"k1": ("K1.pdf", "key"), "k2": ("a wang 2020 virtual.pdf", "author_year_title"), "k5": ("wang 12020 nothing.pdf", "author_year_title")}
    assert [r.key for r in binding.author_year_map(spark.createDataFrame([("Zapf_2013", 2013), ("Ng_2001", 2001)], "key string, year int"), files).collect()] == ["Zapf_2013"]
    title = papers.select("key", "title").unionByName(spark.createDataFrame([("t", "Virtual trainings for residents")], "key string, title string"))
    held = spark.createDataFrame([("W 等 - 2020 - Virtual training of residents.pdf",), ("X - 2021 - Virtual trainings of resident.pdf",), ("Y - 2021 - Unlike.pdf",), ("no form.pdf",)], "file string")
    assert {r.key: r.file[0] for r in binding.title_map(title, held).collect()} == {"k2": "W", "t": "X"}


def greedy_titles(papers, files, least=0.8):
    """One key after another takes the best file that is left."""
    plain = lambda x: " ".join("".join(c for c in x.lower() if c.isascii() and c.isalnum() or c.isspace()).split())
    free, out = dict(files), {}
    for key, title in sorted(papers):
        mine = plain(title)
        scores = []
        for f, x in free.items():
            theirs = plain(x)
            if mine and theirs:
                ratio = difflib.SequenceMatcher(None, T.plain(mine[:80]), T.plain(theirs[:80])).ratio()
                scores += [(-2 if mine == theirs else -ratio, f)] if mine == theirs or ratio >= least else []
        if scores:
            score, f = min(scores)
            out[key] = (f, min(1.0, -score))
            del free[f]
    return out


@pytest.mark.parametrize("seed,n,copies,top", [(3, 30, 0, 5), (4, 40, 12, 2), (5, 25, 0, 1)])
def test_titles_against_one_after_another(spark, seed, n, copies, top):
    rnd = random.Random(seed)
    words = ["knot", "tying", "in", "virtual", "boxes", "of", "novices", "vr"]
    title = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 6)))
    a = [(f"p{i:03d}", title()) for i in range(n)] + [(f"q{i:03d}", "The same title of all") for i in range(copies)] + [("z", ""), ("r", "the same title of al")]
    b = [(f"f{i:03d} - 2020 - {x}.pdf", x) for i, x in enumerate([title() for _ in range(n)] + ["the same title of all"] * (copies - 2 if copies else 0))]
    got = binding.title_map(spark.createDataFrame(a, "key string, title string"), spark.createDataFrame([(f,) for f, _ in b], "file string"), top=top).collect()
    want = greedy_titles(a, b)
    assert {r.key: (r.file, r.score) for r in got} == {k: (f, pytest.approx(s)) for k, (f, s) in want.items()} and len(got) == len(want) >= 4


def test_name_scores_against_all_pairs(spark):
    keys = ["Wang_2024", "De La Garza_2019", "Zapf_2013", "Alkadi_2013", "Ng_2001", "_2001", "nothing", "Zapf_2013", "", "王_2020"]
    files = ["Wang_2024_VR.pdf", "De La Garza - 2019 - Title.pdf", "De La Garza \u7b49 - 2019 - Title.pdf", "Zapf\u548cUjiki - 2013 - T.pdf", "Al-Kadri - 2013 - T.pdf", "Wang - 2020 - Knots.pdf", "王 - 2020 - 结.pdf", "no form.pdf", ".pdf"]
    bare = lambda x: re.sub("[^a-z0-9\u4e00-\u9fff]", "", re.sub(r"\.pdf$", "", x.strip().lower()))

    def score(key, file):
        a, b = bare(key), bare(file)
        if not a or not b:
            return 0
        if a in b or b in a:
            return 0.95
        k, f = re.match(r"^(.*)_([^_]*)$", key), re.match(r"^(.*?)\s*-\s*([0-9]{4})", file)
        if k and f and k[2].strip() == f[2]:
            x, y = bare(k[1]), bare(re.split("[\u548c&\u7b49]", f[1])[0])
            alike = difflib.SequenceMatcher(None, x, y).ratio()
            if x and y and (x == y or alike >= 0.6):
                return 0.98 if x == y else 0.85 + 0.1 * alike
        return difflib.SequenceMatcher(None, a, b).ratio()

    got = {(r.id, r.place): (r.other, r.score) for r in binding.name_scores(spark.createDataFrame(list(enumerate(keys)), "id int, name string"), spark.createDataFrame(list(enumerate(files)), "other int, name string"), 0.3, 4).collect()}
    want = {}
    for i, k in enumerate(keys):
        best = sorted((-score(k, f), j) for j, f in enumerate(files) if score(k, f) >= 0.3)[:4]
        want |= {(i, n): (j, pytest.approx(-s)) for n, (s, j) in enumerate(best, 1)}
    assert got == want and any(s == (3, 0.98) for s in got.values()) and any(0.91 < s < 0.95 for _, s in got.values())


def test_few_pairs_need_the_table(monkeypatch):
    """Names of one language's syllables share most letters, but no common subsequence of 0.8: these are not looked at further."""
    rnd, seen = random.Random(6), []
    syllables = "th on an er re in ou ha ed nt st at le es of ti ".split()
    name = lambda: "".join(rnd.choice([*syllables, " "]) + rnd.choice(syllables) for _ in range(16))[: rnd.randint(48, 64)]
    ones, names = [name() for _ in range(30)], [name() for _ in range(400)]
    names[7], names[9] = ones[3][:-4] + "xyz", ones[5] + " a"
    whole = likeness.matched
    monkeypatch.setattr(likeness, "matched", lambda a, b, left, *rest: (seen.append(len(left)), whole(a, b, left, *rest))[1])
    i, j = np.repeat(np.arange(30), 400), np.tile(np.arange(400), 30)
    got = likeness.Names(ones, names).ratios(i, j, np.full(len(i), 0.75))
    want = np.array([difflib.SequenceMatcher(None, ones[x], names[y]).ratio() for x, y in zip(i, j)])
    assert {(x, y) for x, y, r in zip(i, j, got) if r >= 0.75} == {(x, y) for x, y, r in zip(i, j, want) if r >= 0.75} >= {(3, 7), (5, 9)}
    assert sum(seen) < 120  # of 12,000


def test_best_names_need_few_tables(monkeypatch):
    """Of names of one language's syllables, whose letters allow most pairs, few are compared in full, also over several blocks."""
    rnd, seen = random.Random(8), []
    syllables = "th on an er re in ou ha ed nt st at le es of ti ".split()
    name = lambda least, most: "".join(rnd.choice([*syllables, " "]) + rnd.choice(syllables) for _ in range(40))[: rnd.randint(least, most)]
    ones, names = [name(40, 60) for _ in range(20)], [name(40, 75) for _ in range(3000)]
    names[5] = names[2500] = ones[2] + " more"
    whole = likeness.matched
    monkeypatch.setattr(likeness, "matched", lambda a, b, left, *rest: (seen.append(len(left)), whole(a, b, left, *rest))[1])
    monkeypatch.setattr(matching, "FIRST_OF", 200)
    best = matching._Best(pd.DataFrame({"name": ones, "nth": range(20), "sure": [0, 0, 2] + [0] * 17}), 0.3, 5, None, True)
    for low in (0, 1500):
        best.add(pd.DataFrame({"name": names[low : low + 1500], "nth": range(low, low + 1500), "held": 1}))
    assert sum(seen) < 0.2 * 20 * 3000
    for i in (0, 2, 7):
        ratio = sorted((-difflib.SequenceMatcher(None, ones[i], x).ratio(), j) for j, x in enumerate(names) if ones[i] not in x)
        last = ratio[2 if i == 2 else 4][0]
        assert {(-s, j) for s, j in ratio if s <= last} <= {(s, j) for s, j, _ in best.found[i]} and not {5, 2500} & {j for _, j, _ in best.found[i]}


def test_common_subsequences_of_several_words():
    """Names of up to 199 characters have more places than a word has bits."""
    rnd = random.Random(9)
    ones, names = (["".join(rnd.choices("abcdef ", k=rnd.randint(1, most))) for _ in range(n)] for most, n in ((150, 6), (199, 40)))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    held = likeness.Names(ones, names)
    want = [[common(a, b) for b in names] for a in ones]
    assert [held.common(i, np.arange(40)).tolist() for i in range(6)] == want
    assert held.common_of(np.repeat(np.arange(6), 40), np.tile(np.arange(40), 6)).reshape(6, 40).tolist() == want


def test_refusals_within_a_part_take_no_rounds(spark, monkeypatch):
    """A hundred ids want the same in the same order, and one before them takes the first: each would refuse the next in a round of its own."""
    rows = [(0, 0, 1.0), *((i, j, 1.0 - j / 1000) for i in range(1, 100) for j in range(100)), (100, 500, 0.5), (101, 500, 0.6)]
    stored, seen = matching.shared.stored, []
    monkeypatch.setattr(matching.shared, "stored", lambda df, name: (seen.append(name), stored(df, name))[1])
    got = {r.id: r.other for r in matching.each_once(spark.createDataFrame(rows, "id int, other int, score double")).collect()}
    assert got == {i: i for i in range(100)} | {100: 500} and len(seen) < 12


def test_likeness_of_many_names_is_difflibs():
    rnd = random.Random(1)
    for letters, most in (("ab", 12), ("abcd efg", 60), ("abcdefghijklmnop \u4e00\u4e8c", 260), ("ab", 230)):
        make = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, most)))
        names = [make() for _ in range(150)]
        ones = [make() for _ in range(12)]
        held = likeness.Names(ones, names)
        i, j = np.repeat(np.arange(12), 150), np.tile(np.arange(150), 12)
        want = np.array([difflib.SequenceMatcher(None, ones[x], names[y]).ratio() for x, y in zip(i, j)])
        assert np.allclose(held.ratios(i, j, np.zeros(len(i))), want)
        assert all((held.bounds(x) >= want[i == x] - 1e-9).all() for x in range(12))
        for least in (0.4, 0.7, 0.85):
            got = held.ratios(i, j, np.full(len(i), least))
            assert all(abs(g - w) < 1e-12 or g == -1 and w < least for g, w in zip(got, want))
def test_judgements_parse(spark):
    answers = ['{"decision": "INCLUDE", "picos": {"P": {"result": "PASS", "evidence": ["q"]}}}', 'Well: {"decision": "EXCLUDE", "exclusion_code": "E1", "picos": {}, "reason": "r"} ok', '{"decision": "PERHAPS", "picos": {}}', '{"decision": "MAYBE"}', "no", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "key int, a string").select("key", quality.parse(F.col("a")).alias("r"))
    got = {r.key: r.r for r in df.collect()}
    assert got[0].picos["P"].result == "PASS" and got[0].picos["S"].result == "UNCERTAIN" and got[0].picos["S"].evidence == [] and got[1].exclusion_code == "E1" and got[1].reason == "r"
    assert [got[i] for i in (2, 3, 4, 5)] == [None] * 4
    bare = spark.createDataFrame([(1, None, None, "t")], "key int, decision string, exclusion_code string, text string").withColumn("picos", F.lit(None).cast("map<string, struct<result: string, evidence: array<string>, analysis: string>>"))
    assert sorted(r.issue for r in quality.issues(bare).collect()) == ["decision missing", "picos missing"]


def test_guards_reports_and_runs(spark):
    papers = spark.createDataFrame([(1, "a|b", 2020, None), (2, "t", 0, "p")], "key int, title string, year int, path string")
    none = spark.createDataFrame([], "key int, decision string, code string, at timestamp, p string, i string, c string, o string, s string")
    text = reports.render(reports.summary(papers, none), "Report", reports.SECTIONS)
    assert text.count("\n## ") == 7 and "| remaining | 2 |" in text
    issues = spark.createDataFrame([("FAIL", "lock", "u|1", "m", "e"), ("INFO", "lock", "u", "n", "")], "severity string, scope string, uid string, message string, evidence string")
    assert "FAIL lock u\\|1" in reports.render(reports.gate_report(issues), "Gate", ["gate", "issues"]) and "| passed | false |" in reports.render(reports.gate_report(issues), "Gate", ["gate"])
    found = spark.createDataFrame([("HIGH", "u", "c", "e")], "severity string, uid string, category string, evidence string")
    assert {(r.item, r.value) for r in reports.audit_report(found, issues).collect()} >= {("HIGH", "1"), ("audited", "2")}
    assert {r.value for r in reports.validation_report(spark.createDataFrame([("confirmed_exclude", 3), ("false_positive", 1)], "label string, n long")).filter("section = 'accuracy'").collect()} == {"0.75"}
    checks = {r.check: r.ok for r in gates.database_guard(["papers"], ["papers"], papers.limit(0), papers).collect()}
    assert checks == {"tables": True, "papers": False, "screening": False}
    lock = spark.createDataFrame([("l", 2, 1, 3)], "scope string, total_included int, total_excluded int, n_records int")
    assert gates.lock_counts(lock).count() == 0 and {r.message for r in gates.lock_counts(lock, 3, 2, True).collect()} == {"total_included unexpected", "total_excluded unexpected", "records differ from total_included"}
    empty = spark.createDataFrame([], "run long, at long")
    assert runs.newest_pair(empty, empty).first().pairing == "MISSING"
    calls = spark.createDataFrame([(4, 4, 5), (4, 1, None), (4, 1, 700), (0, 0, 10), (8, 1, 599)], "total_calls int, completed_calls int, age_seconds long")
    assert [(r.status, r.percent) for r in runs.call_status(calls).collect()] == [("completed", 100.0), ("unknown", 25.0), ("stale", 25.0), ("running_or_recent", 0.0), ("running_or_recent", 12.5)]
    ready = {"auto_resume": True, "status": "stale", "can_resume": True, "age_seconds": 600, "child_running": False, "resume_running": False, "since_launch": 180, "completed_calls": 1, "total_calls": 2}
    cases = [ready, *[ready | {k: v} for k, v in (("auto_resume", False), ("status", "running"), ("can_resume", None), ("age_seconds", None), ("age_seconds", 599), ("child_running", True), ("resume_running", True), ("since_launch", 179), ("completed_calls", 2))]]
    kinds = "auto_resume boolean, status string, can_resume boolean, age_seconds long, child_running boolean, resume_running boolean, since_launch long, completed_calls long, total_calls long, i int"
    got = runs.should_resume(spark.createDataFrame([(*c.values(), i) for i, c in enumerate(cases)], kinds)).filter("resume").collect()
    assert [r.i for r in got] == [0]
    again = judging.look_again(spark.createDataFrame([(1, "A systematic review", "x" * 200), (2, "Trial", None), (3, None, None)], "doc_id long, title string, abstract string"), judging.RuleSecondJudge())
    assert {r.doc_id: (r.label, r.confidence) for r in again.collect()} == {1: ("REVIEW", "high"), 2: ("NOT_REVIEW", "medium"), 3: ("UNCERTAIN", "low")}


def one_after_another(events, window, requests, tokens):
    """Admission by looking at all requests before, second by second of those at which one leaves."""
    out, lines = {}, {}
    for key, i, ts, n in sorted(events, key=lambda e: (str(e[0]), e[2], e[1])):
        line = lines.setdefault(key, [])
        now = max(ts, line[-1][0] if line else 0)
        while True:
            inside = [x for x in line if x[0] > now - window]
            if not inside or (len(inside) < requests and sum(x[1] for x in inside) + n <= tokens):
                break
            now = inside[0][0] + window
        line.append((now, n))
        out[key, i] = now
    return out


@pytest.mark.parametrize("span", [200, 100_000])
def test_admission_against_one_after_another(spark, span):
    rnd = random.Random(9)
    events = [(1, i, rnd.randrange(1000), rnd.choice([1, 5, 40, 200])) for i in range(60)] + [(2, i, rnd.randrange(100), 3) for i in range(90)] + [(k, i, rnd.randrange(1000), 30) for k in range(3, 30) for i in range(6)] + [(None, 1, 7, 5), (None, 2, 7, 5)]
    df = spark.createDataFrame(events, "key long, id long, s long, tokens long").selectExpr("key", "id", "timestamp_seconds(s) as ts", "tokens")
    want = one_after_another(events, 60, 8, 80)
    got = limiter.admission(df, 60, 10, 100, span_seconds=span).selectExpr("key", "id", "unix_seconds(admitted_at) as at", "wait_seconds").collect()
    assert {(r.key, r.id): r.at for r in got} == want and len(got) == len(events)
    arrived = {(k, i): s for k, i, s, _ in events}
    assert all(r.wait_seconds == r.at - arrived[r.key, r.id] for r in got) and max(r.wait_seconds for r in got) > 200
    assert limiter.admission(df.limit(0)).count() == 0
