import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tamis.llm import simhash
from tamis.llm.components import components

DOCS = "/root/testdata/sf0.001/documents.parquet"


def slow_fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, fps):
    """Smallest id reachable, over all pairs of (id, fp)."""
    arr = np.array(fps, dtype=np.uint64)
    label = dict(zip(pairs, pairs))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4) + i + 1:
            a, b = root(pairs[i]), root(pairs[j])
            label[max(a, b)] = min(a, b)
    return {x: root(x) for x in pairs}


@pytest.mark.parametrize("crowd,depth", [(2, None), (2000, None), (2000, 3), (2000, 4), (5, 3)])
def test_links_against_all_pairs(spark, monkeypatch, crowd, depth):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "CROWDED_KEYS", 1 << 30)
    rnd = random.Random(7)
    fps = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(40):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 1, 3, 31, (1 << 64) - 1}
    base = rnd.getrandbits(64)
    fps |= {base ^ (rnd.getrandbits(9) << 30) for _ in range(300)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in components(simhash.links(nodes, depth=depth)).collect()}
    want = slow_components(list(range(len(fps))), fps)
    assert {i: got.get(i, i) for i in want} == want
    assert len(got) > 1000


def test_query_against_brute_force(spark):
    odd = [(900001, None), (900002, ""), (900003, " \n"), (900004, "One two"), (900005, "one TWO"), (900006, "É é a b"), (900007, "w " * 20000), (900007, "w w w w"), (None, "one two")]
    docs = spark.read.parquet(DOCS).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("fp", F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: slow_fp(r.text) for r in rows if r.doc_id != 900007}
    for r in got:
        if r.doc_id != 900007:
            assert r.fp & (1 << 64) - 1 == fps[r.doc_id]
    pairs = [(r.doc_id, r.fp & (1 << 64) - 1) for r in got if r.doc_id is not None]
    want = slow_components([p[0] for p in dict.fromkeys(pairs)], [p[1] for p in dict.fromkeys(pairs)]) if len(set(p[0] for p in pairs)) == len(set(pairs)) else None
    if want:
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.component_id for r in got if r.doc_id in (900001, 900002, 900003)} == {900001}
    assert {r.component_id for r in got if r.doc_id in (900004, 900005)} == {900004}


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7), (501, 500)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


def test_near_copies_and_clean_documents(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, truth = [], {}
    for g in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(150, 500))
        for c in range(4 if g % 2 else 1):
            out = [rnd.choice(vocabulary) if c and rnd.random() < 0.015 else w for w in words]
            rows.append((len(rows), " ".join(out)))
            truth[rows[-1][0]] = g
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "one two"), (9004, "one three"), (9005, "w " * 30000), (9005, "w " * 30000), (None, "one two"), (9006, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fps", F.lit("x"))
    found = simhash.near_copies(docs)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert found.count() == len(rows)
    assert all(truth[got[d]] == g for d, g in truth.items())  # clean documents are in no other's group
    five = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows if d in truth}
    alike = [(a, b, len(five[a] & five[b]) / len(five[a] | five[b])) for a in truth for b in truth if a < b and truth[a] == truth[b]]
    assert all(got[a] == got[b] for a, b, j in alike if j >= 0.85) and sum(j >= 0.85 for *_, j in alike) > 30
    near = [got[a] == got[b] for a, b, j in alike if 0.8 <= j < 0.85]
    assert sum(near) >= 0.9 * len(near)
    assert got[9003] == 9002 and got[9004] == 9004 and got[9001] == got[9006] == 9000
    left = simhash.drop_copies(docs, found)
    assert left.columns == docs.columns
    clashing = docs
    for name in ("_gone", "_again", "gone", "again", "id", "row", "n", "a.b"):
        clashing = clashing.withColumn(name, F.lit(1))
    again = simhash.drop_copies(clashing, simhash.near_copies(clashing))
    assert again.columns == clashing.columns and again.count() == left.count()
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(9005) == 1 and ids.count(None) == 1 and 9003 not in ids
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_prints_against_loop():
    import pyarrow as pa

    from tamis.llm import hashing

    texts = ["A b c d e", None, "one", "x y " * 700, ""]
    got = simhash.prints(pa.array(texts, pa.string()), 2, 3)
    for t, row in zip(texts, got):
        data, offsets = hashing.raw(pa.array([(t or "").lower()]))
        start, end, owner = hashing.find_words(data, offsets)
        h, _ = hashing.shingles(hashing.span(hashing.prefix(data), start, end), owner, 2)
        for s in range(3):
            k = [int(x) for x in hashing.mix(h ^ np.uint64(s * 0x9E3779B97F4A7C15 & (1 << 64) - 1))]
            assert int(row[s]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in k) > len(k))


@pytest.mark.parametrize("block", [40, 500])
def test_near_copies_of_a_large_group_against_all_pairs(spark, monkeypatch, block):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rnd.choices(vocabulary, k=300)
    texts = []
    for i in range(1200):
        share = 0.06 * rnd.random()
        texts.append(" ".join(rnd.choice(vocabulary) if rnd.random() < share else w for w in base))
    texts += [texts[5] + " w1"] * 3 + [" ".join(rnd.choices(vocabulary, k=200)) for _ in range(50)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fps = simhash.prints(pa.array(texts))
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        apart = np.bitwise_count(fps[i + 1 :] ^ fps[i])
        for j in np.flatnonzero((apart.min(axis=1) <= 4) & (apart.sum(axis=1) <= simhash.LIMIT_ALL)) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(texts))}
    assert 1 < len(set(got.values())) < 1000


def test_a_star_of_one_seed_does_not_hide_links(spark, monkeypatch):
    """Document 1 is near all others under one seed and far under the rest; 2 to 5 are near each other."""
    import pyarrow as pa

    rnd = np.random.default_rng(21)
    base = rnd.integers(0, 1 << 63, 8, dtype=np.uint64)
    made = []
    for i in range(5):
        fps = rnd.integers(0, 1 << 63, 8, dtype=np.uint64) if i == 0 else base ^ np.uint64(0b111 << 3 * i)
        fps[0] = base[0] ^ np.uint64(i and 1 << i)
        made.append(fps)
    texts = [f"text {i}" for i in range(5)]
    monkeypatch.setattr(simhash, "prints", lambda column, k, seeds: np.array([made[int(t.split()[1])] for t in column.to_pylist()]).reshape(-1, 8))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2}
