import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tamis.llm import classifier, hashing


def test_features_do_not_cross_texts():
    texts = ["ab cd cd", None, "", "abc", "é x", " a  a a", "w " * 1000, "日本語 текст é"]
    together = list(classifier.counted(pa.array(texts, pa.string())))
    alone = [next(classifier.counted(pa.array([t], pa.string()))) for t in texts]
    for (a, n), (b, m), t in zip(together, alone, texts):
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()
        words, chars = (t or "").split(), len(t or "")
        assert n.sum() == (len(words) + max(0, len(words) - 1) + max(0, chars - 2) + max(0, chars - 3) if words else 0)


def test_grams_are_of_characters():
    def grams(text):
        data, offsets = hashing.raw(pa.array([text]))
        return [b.tolist() for b, _ in list(classifier.features(data, offsets))[2:]]

    for text in ("añb ñañ", "日本語日本語", "x𐐀yx𐐀y"):
        threes, fours = grams(text)
        for k, found in ((3, threes), (4, fours)):
            want = [text[i : i + k] for i in range(len(text) - k + 1)]
            same = {(a, b) for a in range(len(want)) for b in range(len(want)) if want[a] == want[b]}
            assert same == {(a, b) for a in range(len(want)) for b in range(len(want)) if found[a] == found[b]}


def slow_train(rows, dimensions, epochs, rate, seed):
    """One number at a time, from the gradients of the cross entropy."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dimensions, 1 / dimensions, (classifier.BUCKETS, dimensions)).astype(np.float32).astype(float)
    soft, bias = [[0.0, 0.0] for _ in range(dimensions)], [0.0, 0.0]
    done, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, n, y = rows[i]
            share = [x / sum(n) for x in n.tolist()]
            step = rate * (1 - done / steps)
            done += 1
            mean = [sum(s * table[b][d] for s, b in zip(share, bucket)) for d in range(dimensions)]
            z = [sum(mean[d] * soft[d][c] for d in range(dimensions)) + bias[c] for c in (0, 1)]
            p = [math.exp(x) / (math.exp(z[0]) + math.exp(z[1])) for x in z]
            error = [p[c] - (c == y) for c in (0, 1)]
            back = [sum(soft[d][c] * error[c] for c in (0, 1)) for d in range(dimensions)]
            for c in (0, 1):
                bias[c] -= 0.02 * step * error[c]
                for d in range(dimensions):
                    soft[d][c] -= 0.25 * step * mean[d] * error[c]
            for s, b in zip(share, bucket):
                for d in range(dimensions):
                    table[b][d] -= step * 0.1 * math.sqrt(s) * back[d]
    return {int(b): sum(table[b][d] * (soft[d][1] - soft[d][0]) for d in range(dimensions)) for r in rows for b in r[0]}, bias[1] - bias[0]


def test_train_and_score_against_loop(spark):
    texts = [("the cat sat on the mat", 1), ("*** buy $$$ now", 0), ("a dog and a cat", 1), ("$$$ *** ***", 0), ("one more line of words", 1)]
    rows = [(*f, y) for f, (_, y) in zip(classifier.counted(pa.array([t for t, _ in texts])), texts)]
    weight, bias = classifier.train(rows, 3, 4, 2.0, 9)
    want, want_bias = slow_train(rows, 3, 4, 2.0, 9)
    assert abs(bias - want_bias) < 1e-4 and all(abs(weight[b] - w) < 1e-4 for b, w in want.items())
    docs = [(i, t) for i, (t, _) in enumerate(texts)] + [(9, "cat *** mat"), (10, None)]
    got = {r.doc_id: r.score for r in classifier.score(spark.createDataFrame(docs, "doc_id long, text string"), (weight, bias)).collect()}
    for (d, t), (b, n) in zip(docs, classifier.counted(pa.array([t for _, t in docs], pa.string()))):
        z = sum(float(weight[k]) * m for k, m in zip(b, n.tolist())) / max(1, n.sum()) + bias
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 2e-6


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in classifier.op9_subword_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[d].score, y) for d, y in labels.items() if got[d].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good]) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good text here"), (3, "good text here"), (4, "*** $$$ " * 20000), (None, "good")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (1, None), (3, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    got = sorted((r.doc_id or 0, r.score) for r in classifier.score(docs, model).collect())
    assert [d for d, _ in got] == [0, 1, 2, 3, 3, 4] and got[1][1] == got[2][1] and got[3] == got[4] and got[3][1] > got[5][1]
    few = classifier.fit(docs, labels, most_features=1)  # one document, of whatever size, is learned
    assert (few[0] != 0).any()
    assert {r.score for r in classifier.score(docs, classifier.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert classifier.score(docs.limit(0), model).count() == 0
