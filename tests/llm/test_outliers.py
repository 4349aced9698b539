import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import outliers

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit), failed


def estimate(near):
    return near.mean(0), outliers.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(np.square(outliers.FLOORS))


def slow_mcd(x, starts=60):
    """FAST-MCD by numpy, on its own: random starts of five rows, the h nearest by rank, the least
    determinant of the (regularised) covariance. Returns mean, covariance, log determinant."""
    rng, h, best = np.random.default_rng(3), int(np.ceil(len(x) * outliers.SHARE)), (None, None, np.inf)
    for _ in range(starts):
        mean, cov = estimate(x[rng.choice(len(x), 5, replace=False)])
        last = np.inf
        while True:
            d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
            mean, cov = estimate(x[np.argsort(d, kind="stable")[:h]])
            det = np.linalg.slogdet(cov)[1]
            if not det < last - 1e-9:
                break
            last = det
        if det < best[2]:
            best = mean, cov, det
    return best


def test_counts_against_loop(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rep = "a b c d e f g h i "
    texts += [None, "", " \n\t", "one", rep * 2, rep * 3 + "x y z " + rep, "w " * 20000, "é $5 | <b>\n \né\né", "x\r\nx\r\ny", "a\x1fb c d e", "q " * 8, "q " * 9, "1 2 3 4 5 6 7 8 0 1 2 3 4 5 6 7 8 9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = {r.doc_id: tuple(r)[1:] for r in outliers.counts(df, [F.col("doc_id")]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == slow_counts(t), (i, t and t[:60])


def test_verdicts_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"))
    odd = [(90001, None, "en", "hot"), (90002, "x " * 40, None, None), (90003, "some words of a text " * 9, "fr", None), (None, "word and " + " ".join(f"w{i}" for i in range(40)), None, "hot")] + [(90001, "again " + " ".join(f"v{i}" for i in range(30)), "en", "hot")] * 2
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")).withColumn("g", F.lit(1)).withColumn("kept", F.lit("x"))
    got = outliers.verdicts(docs, [F.col("doc_id"), F.struct("lang", "source", "text").alias("row")]).collect()
    assert len(got) == docs.count()
    groups, pools, vectors = defaultdict(list), defaultdict(list), {}
    for i, r in enumerate(got):
        n, c, s, lines, dup, rep, failed = slow_counts(r.row.text)
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (n, rep, failed)
        if failed:
            assert not r.kept
            continue
        angle = lambda a, b: np.arcsin(np.sqrt(min(1.0, a / max(1, b))))
        vectors[i] = [np.log(max(1, c) / max(1, n)), angle(s, c), angle(dup, lines), angle(rep, n)]
        groups[r.row.lang, r.row.source].append(i)
    final = []
    for (lang, _), rows in groups.items():
        (final.append(rows) if len(rows) >= outliers.LEAST_ROWS else pools[lang].extend(rows))
    everyone = []
    for rows in pools.values():
        (final.append(rows) if len(rows) >= outliers.LEAST_ROWS else everyone.extend(rows))
    (final.append(everyone) if len(everyone) >= outliers.LEAST_ROWS else None)
    judged = set()
    for rows in final:
        x = np.array([vectors[i] for i in rows])
        mean, cov, _ = slow_mcd(x)
        d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
        ours = np.array([got[i].distance2 for i in rows])
        # h is exact up to a bucket of distances, so the estimates differ by a few rows in the middle.
        assert np.median(np.abs(ours - d) / (1 + d)) < 0.1
        near = np.abs(d - outliers.CUT) < 0.3 * outliers.CUT
        assert (np.array([got[i].kept for i in rows]) == (d <= outliers.CUT))[~near].all() and near.mean() < 0.05
        assert all(got[i].kept == (got[i].distance2 <= outliers.CUT) for i in rows)
        judged.update(rows)
    assert all(got[i].kept and got[i].distance2 is None for i in set(vectors) - judged)
    assert len(final) >= 4 and any(not got[i].kept for i in judged)
    assert outliers.verdicts(docs.limit(0), [F.col("doc_id")]).count() == 0
    good = outliers.keep_good(docs)
    assert good.columns == docs.columns and sorted(map(str, (r.text for r in good.collect()))) == sorted(str(r.row.text) for r in got if r.kept)


def test_least_determinant_and_centring(spark):
    """Groups in which a single start could go wrong: a far cluster of a quarter of the rows, strong
    correlation, and coordinates far from zero."""
    rng = np.random.default_rng(12)
    data, n = [], 400
    for g in range(4):
        mix = np.linalg.cholesky([[1, 0.9, 0.2, 0], [0.9, 1, 0, 0.1], [0.2, 0, 1, 0.5], [0, 0.1, 0.5, 1]])
        x = rng.normal(size=(n, 4)) @ mix.T * 0.3
        if g in (1, 3):
            x[: n // 5] = rng.normal(size=(n // 5, 4)) * 0.05 + [1.5, -1.5, 1.0, 0.0]
        data.append(x + (1e5 if g == 2 else 0.0))
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in enumerate(data) for r in x], "g long, x0 double, x1 double, x2 double, x3 double")
    got = {r.g: r for r in outliers.estimates(rows.repartition(4)).collect()}
    for g, x in enumerate(data):
        mean, _, det = slow_mcd(x)
        assert got[g].logdet <= det + 0.05, (g, got[g].logdet, det)
        assert np.abs(np.array([got[g][f"m{i}"] for i in range(4)]) - mean).max() < 0.06
