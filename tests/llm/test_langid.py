import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import langid


def slow_bundle(text, dimensions=langid.DIMENSIONS):
    s = [0]
    for c in (text or "").lower():
        k = ord(c) if unicodedata.category(c)[0] == "L" else 0
        if k or s[-1]:
            s.append(k)
    if s[-1]:
        s.append(0)
    one = {k: [v[0].astype(np.int64) for v in langid.letter_vectors(np.array([k]), dimensions)] for k in set(s)}
    out = np.zeros(dimensions, dtype=np.int64)
    for a, b, c in zip(s, s[1:], s[2:]):
        if b:
            out += one[a][0] * one[b][1] * one[c][2]
    return out


def test_bundles_against_loop(monkeypatch):
    texts = ["Ab cd", None, "", "  ", "x", "Élan -- vital 12 a", "é", "İstanbul ßß", "日本 語", "word " * 3000, "a b", "мир труд", "𐐀𐐁 x"]
    for codes in (1 << 20, 1):
        monkeypatch.setattr(langid, "_CODES", codes)
        got, letters = langid.bundles(texts)
        for t, row, n in zip(texts, got, letters):
            assert (row == slow_bundle(t)).all(), t
            assert n == sum(unicodedata.category(c)[0] == "L" for c in (t or "").lower())
    first, second, third = langid.letter_vectors(np.array([97, 0x4E00]), 100)
    assert (first[1] == np.roll(third[1], 2)).all() and (second[0] == np.roll(third[0], 1)).all() and set(third.ravel().tolist()) == {-1, 1}
    many = langid.letter_vectors(np.arange(0x4E00, 0x4F00))[2].astype(int)
    alike = many @ many.T / langid.DIMENSIONS
    assert np.abs(alike - np.eye(len(many))).max() < 0.2  # every letter is unlike every other


SPEECH = {
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
    "uk": "всі люди народжуються вільними і рівними у своїй гідності та правах вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства",
    "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα είναι προικισμένοι με λογική και συνείδηση και οφείλουν να συμπεριφέρονται μεταξύ τους",
    "zh": "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待",
    "ja": "すべての人間は 生れながらにして自由であり かつ 尊厳と権利とについて平等である 人間は 理性と良心とを授けられており 互いに同胞の精神をもって行動しなければならない",
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood",
}


def test_prediction_against_brute_force_in_many_scripts(spark):
    rng = np.random.default_rng(5)
    texts, langs = [], []
    for lang, speech in SPEECH.items():
        words = speech.split()
        for _ in range(12):
            texts.append(" ".join(rng.choice(words, 8)))
            langs.append(lang)
    prototypes = langid.fit(spark.createDataFrame(list(zip(texts[::2], langs[::2])), "text string, lang string"))
    slow = {k: sum(slow_bundle(t) for t, y in zip(texts[::2], langs[::2]) if y == k) for k in SPEECH}
    rows = list(enumerate(texts)) + [(500, "x"), (501, "Ξένος τόπος")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), prototypes).collect()}
    for i, t in rows:
        v = slow_bundle(t)
        cosine = {k: round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 6) for k, p in slow.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert abs(got[i].score - max(0, cosine[best])) < 1e-5
        assert got[i].lang_pred == best or cosine[best] - cosine[got[i].lang_pred] < 1e-5
    assert sum(got[i].lang_pred == y for i, y in enumerate(langs)) >= 0.95 * len(langs)


def test_unknown_languages_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(2)
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    noise = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 2000))
    odd = [(9001, polish * 3), (9002, noise), (9003, None), (9004, ""), (9005, "12 !!"), (9006, SPEECH["ru"]), (9007, noise[:300])]
    more = spark.createDataFrame([(i, t, None, "s", 0) for i, t in odd], docs.schema)
    every = docs.unionByName(more).withColumn("score", F.lit("x")).withColumn("_size", F.lit(1))
    kept = langid.keep_known(every)
    assert kept.columns == every.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not set(ids) & {i for i, _ in odd} and len(ids) >= 0.97 * docs.count()
    assert langid.keep_known(every.limit(0)).count() == 0 and langid.keep_known(every.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op7_hyperdimensional_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) and 0 <= got[d.doc_id].score <= 1
    held = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) > 0.97 * len(held)


def test_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("123", "xx"), ("ein Hund", None)], "text string, lang string")
    prototypes = langid.fit(train.repartition(3))
    assert list(prototypes) == ["en", "fr"]
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 !!", "c"), (4, "the dog", "d"), (4, "the dog", "d"), (5, "chien " * 50000, "e"), (None, "le chat", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict(docs, prototypes).collect()))
    assert got == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr")]
    assert langid.predict(docs, {}).filter("lang_pred = 'und' and score = 0").count() == len(rows)
    assert langid.fit(train.limit(0)) == {} and langid.predict(docs.limit(0), prototypes).count() == 0
    a, b = langid.fit(train), langid.fit(train.union(train.filter("lang = 'de'")).repartition(2).withColumn("x", F.lit(1)))
    assert all((a[k] == b[k]).all() for k in a)
