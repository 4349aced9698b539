import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd

from tamis.llm import trie
from tests.conftest import SF


def slow_rebuilt(rows):
    """The contract by dictionaries; rows (conv_id, turn, role, text) without ties of turn."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c in list(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - c % 5 if c >= 0 else -(-c - -c % 5), [])
        out[c] = base[:h] + own[c][h:]
    return out


def slow(conversations):
    """Every prefix of every conversation."""
    members, last = defaultdict(list), {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own + sum(saved[k] for k in kids[p])
        ends = sorted(c for c in members[p] if len(conversations[c]) == len(p))
        last[p] = p[-1] if p else (None, None)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str), {(min(members[p]), len(p)): last[p] for p in members}


def nodes_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n, roles="ua", words=3, most=9, copies=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [(t, rng.choice(roles), "x" * rng.randrange(words)) for t in range(rng.randrange(1, most))]
        rows += [(c, t, r, x) for t, r, x in turns]
    rows += [(n + 5 * i, t, "u", "same") for i in range(copies) for t in range(3)]
    return rows


def check(spark, rows, blocks):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as key", "2 as sizes", "3 as `a.b`")
    want, _ = slow(slow_rebuilt(rows))
    total = sum(len(x) for x in slow_rebuilt(rows).values())
    got = nodes_of(trie.prefix_trie(trie.rebuilt(df), max(1, total // blocks)))
    assert got == want


def test_made_tables(spark):
    for seed, n, words, most, copies, blocks in [(1, 40, 2, 6, 0, 1), (2, 60, 2, 12, 0, 13), (3, 200, 3, 5, 0, 30), (4, 100, 1, 14, 0, 40), (5, 30, 4, 4, 300, 25)]:
        check(spark, made(seed, n, words=words, most=most, copies=copies), blocks)


def test_one_key_over_many_blocks(spark):
    rows = [(5 * i, t, "u", "é") for i in range(400) for t in range(2)] + [(5 * i + 2000, 0, "u", "é") for i in range(300)]
    check(spark, rows, 40)


def test_odd_rows(spark):
    rows = [(1, 0, "u", "only"), (3, None, None, None), (3, 0, "", "é\U0001f600"), (7, 2, "u", "x" * 500_000), (-7, 0, "u", "minus"), (-5, 0, "u", "base"), (None, 0, "u", "lost"), (10, 0, "u", "a"), (10, 1, "u", "b"), (11, 0, "u", "a")]
    rows += [(20, t, "u", f"{t % 3}") for t in range(3000)] + [(25, t, "u", f"{t % 3}") for t in range(2500)]
    check(spark, rows, 4)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(df.limit(0))).collect() == []
    # Ties of turn: by role, then by digest; runs agree, and repeated rows are two turns.
    tied = [(5, 0, "b", "x"), (5, 0, "a", "y"), (5, 0, "a", "y")]
    nodes = nodes_of(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(tied, df.schema))))
    assert [r[1] for r in nodes] == [0, 1, 2, 3]
    texts = trie.with_turns(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(tied, df.schema))), spark.createDataFrame(tied, df.schema)).orderBy("depth").collect()
    assert [(r.role, r.text) for r in texts] == [(None, None), ("a", "y"), ("a", "y"), ("b", "x")]


def test_query_texts_and_sql(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    want, last = slow(slow_rebuilt(rows))
    got = trie.op11_conversation_trie(spark, SF)
    assert nodes_of(got) == want
    texts = trie.with_turns(got, conversations).collect()
    assert {(r.conv_id, r.depth): (r.role, r.text) for r in texts} == last and len(texts) == len(last)
    duckdb.sql(f"create or replace view conversations as select * from '{SF}/conversations.parquet'")
    sql = duckdb.sql(trie.ORACLE_SQL["op11_conversation_trie"]).df()
    pd.testing.assert_frame_equal(*(x.sort_values(["conv_id", "depth"]).reset_index(drop=True) for x in (got.toPandas(), sql[got.columns])), check_dtype=False)
