import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_targets(sizes, weights):
    """Resharing by bisection on the common factor instead of rounds."""
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes) else (low, mid)
    return [min(3 * s, high * w) for s, w in zip(sizes, weights)]


def test_shares():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        sizes = rng.integers(0, 10000, n)
        weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
        got = mixing.shares(sizes, weights)
        assert np.allclose(got, slow_targets(sizes.tolist(), weights), rtol=1e-6, atol=1e-3)
        assert abs(got.sum() - sizes.sum()) < 1e-6 * max(1, sizes.sum())


def test_tree_is_exact_and_mixed():
    quotas = np.array([4000, 90, 0, 800])
    tree = mixing.splitting_tree(quotas, 7, 5)
    assert (tree.sum(0) == quotas).all() and tree.sum(1).max() - tree.sum(1).min() <= 3
    assert (np.abs(tree[:, 0] - 4000 / 7) < 60).all() and (tree == mixing.splitting_tree(quotas, 7, 5)).all()


def test_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    odd = [(9001, None, None), (9002, "", "empty"), (9003, "a b  c\td", None), (9003, "a b  c\td", None), (9004, "w " * 20000, "long"), (None, "no id", "src1"), (9005, "é\x1fé x", "src2")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string")).withColumn("size", F.lit("x"))
    got = mixing.taken(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in rows)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, slow_targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    source = {r.doc_id: r.source for r in rows}
    words = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-3 and 0 <= r.taken <= 3 * r["size"]
        words[s] += r.taken
    for s in names:
        assert abs(words[s] - target[s]) <= 4, s
    again = mixing.taken(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.taken(docs.limit(0)).count() == 0


def test_nothing_is_lost_where_texts_are_empty(spark):
    rows = []
    for source, words, n in (("a", 10_000, 400), ("b", 30_000, 600), ("c", 20_000, 300)):
        full = n // 2 if source != "c" else n
        each = [words // full + (i < words % full) for i in range(full)]
        rows += [(" ".join(["w"] * k), source) for k in each] + [("" if i % 2 else None, source) for i in range(n - full)]
    rows += [("one", "single"), ("", "nothing"), (None, None), ("x y", None)]
    docs = spark.createDataFrame([(i * 7 % len(rows), *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.taken(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    words, target = defaultdict(int), {}
    for r in got:
        words[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(got) == len(rows) and set(target) == {"a", "b", "c", "single", "nothing", None}
    assert all(words[s] == round(t) for s, t in target.items()), (dict(words), target)
    few = mixing.taken(docs, shards=3, seed=5).collect()
    assert sum(r.taken for r in few) == sum(r.taken for r in got)


def test_mix_follows_the_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = {r.doc_id: r.taken for r in mixing.taken(docs, shards=8).collect()}
    seen, where = defaultdict(int), defaultdict(lambda: defaultdict(int))
    last = {}
    for r in mixing.mix(docs, shards=8).select("mixed.*").collect():  # in the order of the partitions
        seen[r.row.doc_id] += r.words
        where[r.shard][r.row.source] += r.words
        assert last.get(r.shard, r.place) <= r.place
        last[r.shard] = r.place
    assert dict(seen) == {d: x for d, x in plan.items() if x}
    assert set(where) == set(range(8))
    every = sum(plan.values())
    for source in {r.source for r in docs.select("source").distinct().collect()}:
        share = sum(w[source] for w in where.values()) / every
        assert all(abs(w[source] / sum(w.values()) - share) < 0.25 for w in where.values())


def test_a_changed_tree_changes_what_is_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = mixing.taken(docs, shards=8).collect()
    none = mixing.taken(docs, shards=8, tree=lambda quotas, shards, seed: np.zeros((shards, len(quotas)), np.int64)).collect()
    assert all(r.taken == 0 for r in none) and len(none) == len(whole)

    def half(quotas, shards, seed):  # the later shards stay empty
        out = mixing.splitting_tree(quotas, shards, seed)
        out[shards // 2 :] = 0
        return out

    some = mixing.taken(docs, shards=8, tree=half).collect()
    part = sum(r.taken for r in some) / sum(r.taken for r in whole)
    assert 0.35 < part < 0.65 and all(r.taken <= 3 * r["size"] for r in some)
    other = lambda q, s, seed: mixing.splitting_tree(q, s, seed + 1)
    a, b = ({(r.mixed.row.doc_id, r.mixed["pass"]): r.mixed.shard for r in mixing.mix(docs, shards=8, tree=t).collect()} for t in (mixing.splitting_tree, other))
    assert set(a) == set(b) and a != b
