from pyspark.sql import functions as F

from tamis.operators import progress
from tamis.sources import files

KINDS = "uid string, decision string, code string, reason string, title string, year int, p struct<result: string, evidence: array<string>, note: string>, c struct<result: string, evidence: array<string>>, o string"


def test_records_are_read_back_as_written(spark, tmp_path):
    quote = "a quoted line that is long enough to count as evidence"
    rows = [
        ("u1", "EXCLUDE", "E5", "no control group", "A title", 2020, ("PASS", [quote, "short"], "a note"), ("FAIL", [quote + " two"]), "plain text"),
        ("u2", "INCLUDE", None, None, None, None, ("UNCERTAIN", None, None), None, None),
    ]
    made = spark.createDataFrame(rows, KINDS)
    pages = {r.uid: r.text for r in files.markdown(made).collect()}
    assert "**排除码**（如EXCLUDE）：E5" in pages["u1"] and "no control group" in pages["u1"] and "| **年份** | 2020 |" in pages["u1"] and "a note" in pages["u1"] and "**排除码**（如EXCLUDE）：无" in pages["u2"]
    for uid, decision in (("u1", "EXCLUDE"), ("u2", "INCLUDE")):
        (tmp_path / "wrong").mkdir(exist_ok=True)
        (tmp_path / "wrong" / f"{uid}.md").write_text(pages[uid], encoding="utf-8")
    back = files.markdown_records(spark, str(tmp_path / "wrong"))
    back = {r.uid: r for r in back.select("*", *[files.result(F.col(d)).alias(f"is_{d}") for d in "PCS"], files.quotes(F.col("P")).alias("q"), files.quotes(F.col("C")).alias("r")).collect()}
    one, two = back["u1"], back["u2"]
    assert (one.decision, one.is_P, one.is_C, one.is_S, one.q, one.r) == ("EXCLUDE", "PASS", "FAIL", None, [quote], [quote + " two"]) and one.O.strip() == "plain text"
    assert (two.decision, two.is_P, two.is_C, two.q) == ("INCLUDE", "UNCERTAIN", None, [])
    files.export_markdown(made, str(tmp_path / "each"), ("decision", "uid"))
    assert len(list((tmp_path / "each").glob("decision=*/uid=*/*.txt"))) == 2


def test_what_a_stored_progress_gets_wrong(spark):
    papers = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    done = spark.createDataFrame([(0, "INCLUDE", "a"), (1, "EXCLUDE", "b"), (2, "MAYBE", None)], "doc_id long, decision string, path string")
    paths = spark.createDataFrame([("a",)], "path string")
    right = progress.progress(papers, done, "doc_id")
    assert [tuple(r) for r in progress.verify(right, papers, done, "doc_id", paths).collect()] == [("file", "1", "b", None)]
    assert progress.verify(right, papers, done, "doc_id").count() == 0
    wrong = spark.createDataFrame([(5, 2, None)], "total long, processed long, maybe_count long")
    got = {(r.check, r.subject): (r.expected, r.actual) for r in progress.verify(wrong, papers, done, "doc_id").collect()}
    assert got == {("cache", "processed"): ("3", "2"), ("cache", "remaining"): ("2", "0"), ("cache", "include_count"): ("1", "0"), ("cache", "exclude_count"): ("1", "0"), ("cache", "maybe_count"): ("1", "0")}
    orphan = done.union(spark.createDataFrame([(77, "INCLUDE", "a")], done.schema))
    assert ("conservation", "5", "6") in {(r.check, r.expected, r.actual) for r in progress.verify(progress.progress(papers, orphan, "doc_id"), papers, orphan, "doc_id").collect()}
    assert progress.verify(right.limit(0), papers.limit(0), done.limit(0), "doc_id", paths).count() == 0
