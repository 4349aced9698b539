"""Every query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from tamis.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        return "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df.astype(object).where(df.notna(), None)[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_lock_contents_of_odd_texts_and_pages(spark, tmp_path):
    """Null, empty and unreadable texts, and pages without html or title, give what the SQL gives."""
    con, name = duckdb.connect(), "q_lock_contents"
    texts = ["null", "''", "'### $$$'", "'  '", "chr(10)", "'系统综述 abc'", "repeat('!', 950) || text", "'İSTANBUL ΣΑΣ KELVIN'", "text", "text"]
    htmls = ["null", "''", "replace(html, 'title', 'TITLE')", "replace(html, '</title>', '')", "html", "html", "html"]
    for t, key, column, odd in (("documents", "doc_id", "text", texts), ("pages", "page_id", "html", htmls)):
        cases = " ".join(f"when {i} then {x}" for i, x in enumerate(odd))
        con.execute(f"copy (select * replace (case {key} % {len(odd)} {cases} end as {column}) from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = rows(con.execute(catalogue.ORACLE_SQL[name]).fetchdf())
    assert sum(r[1] == "title overlap low" for r in want) > 5
    assert rows(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == want


#: Likeness by matching blocks and waiting in line can't be told in SQL; test_operators holds these against
#: all pairs, and against one request after another.
NO_SQL = {"q_fuzzy_match", "q_title_map", "q_name_score", "q_rate_admission"}


def test_all_other_queries_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == NO_SQL
