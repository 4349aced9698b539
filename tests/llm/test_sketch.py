import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tamis.llm import sketch


def resemblance(a, b, k=5):
    def of(text):
        w = [x.decode() for x in text.encode().lower().split()]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_neighbours_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "One\ttwo "), (9006, "w x " * 30000), (9007, "é" * 7), (None, "null id"), (9009, "a b c d e f"), (9009, "b b c d e f"), (-5, "below zero")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("part", F.lit(1)).repartition(5)
    got = sketch.neighbours(docs).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    assert len(got) == len(rows)
    by = {(r.doc_id, r.edited_sha256): r for r in got}
    estimated, true = [], []
    for i, (_, doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][2]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = by[doc, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(text)
        (a, b, c), (x, y, z) = sketch.marked(pa.array([text, edited, following]))
        assert (sketch.to_text(a, x), sketch.to_text(b, y)) == (r.fingerprint, r.edited_fingerprint)
        assert r.near_edited == sketch.likeness(a, b, x, y) and r.near_next == sketch.likeness(a, c, x, z)
        if not len(a):  # nothing is kept: equal sets of shingles or not
            assert (r.near_next == 1.0) == (resemblance(text, following) == 1.0)
            assert (r.near_edited == 1.0) == (resemblance(text, edited) == 1.0)
        if len(text) > 1500:
            estimated += [r.near_edited, r.near_next]
            true += [resemblance(text, edited), resemblance(text, following)]
    assert np.abs(np.array(estimated) - true).mean() < 0.05
    one = sketch.neighbours(docs.filter("doc_id = 9006")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sketch.neighbours(docs.limit(0)).count() == 0


def test_merge_and_containment():
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 5000, 40000)]
    book, note = " ".join(words), " ".join(words[7000:9000])
    a, b, other = sketch.sketches(pa.array([book, note, " ".join(reversed(words[:20000]))]))
    assert sketch.containment(b, a) == 1.0 and abs(sketch.containment(a, b) - 0.05) < 0.01
    assert sketch.likeness(a, other) < 0.01
    x, y = sketch.sketches(pa.array([" ".join(words[:20004]), " ".join(words[20000:])]))
    assert (sketch.merge(x, y) == a).all() and (sketch.from_text(sketch.to_text(a)) == a).all()
    assert abs(len(a) * sketch.SCALE / 39996 - 1) < 0.05


def test_texts_of_which_nothing_is_kept():
    texts = [f"{a} q w e r" for a in "abcdefghijklmnop"] + ["A q w e r", "", None, " \n"]
    got, marks = sketch.marked(pa.array(texts))
    empty = [i for i in range(16) if not len(got[i])]
    assert len(empty) > 5 and len({marks[i] for i in empty}) == len(empty) and all(marks[empty])
    assert sketch.likeness(got[empty[0]], got[empty[1]], marks[empty[0]], marks[empty[1]]) == 0.0
    assert marks[0] == marks[16] and list(marks[17:]) == [0, 0, 0]
    assert sketch.likeness(got[17], got[18], marks[17], marks[18]) == 1.0 and sketch.to_text(got[17], 0) == ""
    assert len({sketch.to_text(got[i], marks[i]) for i in empty}) == len(empty) and not len(sketch.from_text(sketch.to_text(got[empty[0]], marks[empty[0]])))


def test_short_texts_in_long_ones():
    rng = np.random.default_rng(6)
    pieces = [[f"w{x}" for x in rng.integers(0, 300, 200)] for _ in range(300)]
    notes = sketch.sketches(pa.array([" ".join(p[50:57]) for p in pieces]))
    books = sketch.sketches(pa.array([" ".join(p) for p in pieces]))
    assert all(sketch.containment(n, b) == 1.0 for n, b in zip(notes, books))  # 1.0 is true of each
    others = [sketch.containment(n, b) for n, b in zip(notes, books[1:]) if len(n)]
    assert max(others) == 0.0 and len(others) > 150
    assert 0.2 < sum(map(len, notes)) / 900 < 0.3  # one in four of three shingles each
    for n, b in zip(notes, books):
        assert (sketch.merge(n, b) == b).all()
    # every kept hash is below the threshold, whatever the length
    assert all((x < np.uint64((1 << 64) // sketch.SCALE)).all() for x in [*notes, *books])
    # long, short and empty texts in one sketch are those of their shingles together
    every = sketch.sketches(pa.array([" ".join(p) for p in pieces[:3]] + ["one", None]))
    merged = every[0]
    for x in every[1:]:
        merged = sketch.merge(merged, x)
    assert set(merged.tolist()) == set().union(*(set(x.tolist()) for x in every))
