import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamis.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_combinations_and_nnls():
    for units, depth in ((8, 3), (16, 2), (12, 4)):
        want = {tuple(sorted(c, reverse=True)) for k in range(1, depth + 1) for c in combinations_with_replacement(range(1, units + 1), k) if sum(c) == units}
        assert set(packing.combinations(units, depth)) == want and len(packing.combinations(units, depth)) == len(want)
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * rng.integers(1, 50)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-6  # the conditions of optimality
    a = np.array([[1.0, 1, 0], [0, 1, 2], [1, 1, 1]])
    assert np.allclose(packing.nnls(a, a @ [2, 0, 3]), [2, 0, 3])


def test_plan_fits_the_histogram():
    rng = np.random.default_rng(4)
    for histogram in (rng.integers(0, 900, 33), np.array([0, *[0] * 16, *[50] * 16]), np.array([0] * 33), np.array([0, 5000, *[0] * 31])):
        histogram[0] = 0
        used = np.zeros(33, dtype=int)
        for combo, n in packing.plan(histogram):
            assert sum(combo) == 32 and n > 0
            np.add.at(used, list(combo), n)
        assert (used <= histogram).all()
    uniform = np.array([0, *[700] * 32])
    assert sum(sum(c) * n for c, n in packing.plan(uniform)) > 0.95 * sum(i * 700 for i in range(33))


def check(got, docs, window):
    tok = Tokenizer.from_file(PATH)
    want = sorted((d or -9, len(ids := [*tok.encode(t or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sum(r.length for r in got) == sum(n for _, n, _ in want)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    for d, rows in by_doc.items():
        if len(texts[d]) == 1:
            ids, at = texts[d][0], 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    return len(by_sequence)


def test_pack_every_id_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, "a b c"), (9003, "a b c"), (None, "x"), (9005, "word " * 30000), (9006, "É ça 12 <|endoftext|>")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("piece", F.lit("x")).withColumn("length", F.lit(1)).repartition(3)
    for window, unit in ((2048, 8), (256, 64)):
        packed = packing.pack(packing.tokenize(df, PATH, window=window, unit=unit), window, unit)
        got = packing.placements(packed).collect()
        n = check(got, docs, window)
        total = sum(r.length for r in got)
        assert n <= -(-total // window) * (1.02 if unit == 8 else 1.5)
        rows = packed.collect()
        assert len(rows) == n == len({r.sequence_id for r in rows})
        for r in rows:
            assert len(r.ids) == 2 * sum(p.length for p in r.pieces) <= 2 * window
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_only_short_documents(spark):
    """No combination fills a window: all is laid end to end, over several tasks."""
    docs = [(i, None if i % 3 else "a b") for i in range(9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = packing.packed_documents(df).collect()
    assert check(got, docs, 2048) == -(-sum(r.length for r in got) // 2048)
