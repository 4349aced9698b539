import hashlib
import re

import duckdb

from tamis.llm import fim
from tests.conftest import SF


def slow(text, doc_id):
    """The contract, line by line, with regular expressions."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [(7001, None), (7002, ""), (7003, "\n"), (7004, "\n\n\n"), (7005, "a<S>b\nc"), (7006, "x < P> <S\n> <"), (7007, "é\U0001f600\n\U0001f600"), (7007, "é\U0001f600\n\U0001f600"), (None, "no\nid"), (7008, "line\r\n" * 200_000), (7009, "w" * 1_000_000), (-5, "a\n<M\nS>")]


def test_against_brute_force(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd)
    docs = docs.selectExpr("doc_id", "text", "'x' as form", "1 as n", "'y' as output", "2 as row", "3 as `a.b`")
    out = fim.fill_in_middle(docs)
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(out["output"], out["form"]).alias("back")).collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == sorted((str(i), *slow(t, i), t or "") for i, t in rows)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    assert {"form", "n", "output", "row", "a.b"} <= set(out.select("row.*").columns)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_units():
    for text in ("", "a", "  a b", "a  b\t\nc ", "\n\na\n", "é\U0001f600 x\n", "one two  three"):
        for unit, pattern in {"char": r"(?s).", "word": r"\S+\s*|^\s+", "line": r"[^\n]*\n|[^\n]+"}.items():
            units = fim.Units(text, unit, fim.automaton(unit))
            pieces = re.findall(pattern, text)
            assert units.n == len(pieces) and "".join(pieces) == text
            assert [units.at(k) for k in range(units.n + 1)] == [len("".join(pieces[:k])) for k in range(units.n + 1)], (text, unit)


def test_rates(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'a b c' as text")
    forms = {r.form: r.n for r in fim.fill_in_middle(docs, "word", rate=40, spm=25).groupBy("form").count().selectExpr("form", "count as n").collect()}
    assert 1100 < forms["plain"] < 1300 and 150 < forms["spm"] < 260 and 520 < forms["psm"] < 680


def test_query_and_sql(spark):
    import pandas as pd

    got = fim.op12_aho_corasick_fim(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(fim.ORACLE_SQL["op12_aho_corasick_fim"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns.tolist()], check_dtype=False)
