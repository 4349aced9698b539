import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tamis.llm import common, repair
from tamis.llm.encoding import WordMemo

ODD = [None, "", ",", ".a", "a , b", "a. .b ,c", "x\",y", "3.14,15", "U.S. (a.) b.,", "a,\nb.\n,c", "'s a's ,'t", "!. ?, a", " ", "\n", "a\nb", "a \nb", "\na", " a", "a ", "don't it's", "x  y", "É à ça İI ﬁ", "áb", "tab\tx", "___ a_b", "1234 a1 b2,", "x.\n\n\nY.", "“q” – z", "a,b, c!d!", "..., ..", "ª²³¼ x²", "<|endoftext|> x", "x <|endoftext|> y", "A <|EndOfText|> <|startoftext|>b", "word " * 30000]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memo_equals_library(spark, name, spaced):
    path = public_tokenizers.path(name)
    words, tok = WordMemo(path, spaced), Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD[1:]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_special_tokens_as_in_a_plain_call():
    for name, spaced, want in (("byte_bpe_50k.json", True, [87, 220, 50256, 331]), ("word_bpe_49k.json", False, [343, 49407, 344])):
        assert np.frombuffer(WordMemo(public_tokenizers.path(name), spaced).encode("x <|endoftext|> y"), "<u2").tolist() == want


def slow_repair(docs, first_rule, least):
    """Re-Pair by the book: the one most frequent pair at a time. Returns symbols and rules."""
    rules = []
    while True:
        count = Counter()
        for d in docs:
            i = 0
            while i < len(d) - 1:  # uses that don't overlap
                count[d[i], d[i + 1]] += 1
                i += 2 if i + 2 < len(d) and d[i] == d[i + 1] == d[i + 2] else 1
        if not count or max(count.values()) < least:
            return docs, rules
        pair = max(count, key=lambda p: (count[p], p))
        symbol, out = first_rule + len(rules), []
        rules.append(pair)
        for d in docs:
            new, i = [], 0
            while i < len(d):
                if i + 1 < len(d) and (d[i], d[i + 1]) == pair:
                    new.append(symbol)
                    i += 2
                else:
                    new.append(d[i])
                    i += 1
            out.append(new)
        docs = out


def test_grammar_against_exact_repair():
    rng = np.random.default_rng(8)
    phrases = [rng.integers(0, 90, n).tolist() for n in rng.integers(2, 12, 60)]
    docs = [[x for k in rng.integers(0, 60, rng.integers(0, 60)) for x in phrases[k]] for _ in range(80)] + [[7] * 200, [1, 2] * 90, []]
    ids = np.array([x for d in docs for x in [*d, 0]], dtype=np.uint16)
    ends = np.cumsum([len(d) + 1 for d in docs]) - 1
    symbols, rules, counts = repair.compress(ids, ends, 100)
    exact, exact_rules = slow_repair(docs, 100, repair.LEAST_USES)
    size = 2 * len(symbols) + 8 * len(rules)
    assert size <= 1.1 * (2 * sum(len(d) + 1 for d in exact) + 8 * len(exact_rules))
    back = repair.Grammar(rules, counts, 100).expand(symbols)
    assert (back[ends] == repair.END).all() and np.delete(back, ends).tolist() == np.delete(ids, ends).tolist()
    # nothing that pays is left: no pair within a document has LEAST_USES uses that don't overlap
    left, upto = [], np.flatnonzero(symbols == repair.END)
    for a, b in zip([0, *(upto[:-1] + 1)], upto):
        left.append(symbols[a:b].tolist())
    assert slow_repair(left, 60000, repair.LEAST_USES)[1] == []
    assert len(repair.compress(ids[:1], np.array([0]), 100)[1]) == 0 and len(repair.compress(np.zeros(0, np.uint16), np.zeros(0, int), 100)[0]) == 0


def test_block_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 10, n).astype("<u2") for n in (0, 1, 5000, 3, 9000, 0)]
    block, n = repair.write_block([5, 6, None, 8, 9, 9], [d.tobytes() for d in docs], 0, 50257)
    back = repair.Block(block)
    assert n == sum(len(d) + 1 for d in docs) and len(back.rules) and len(back.symbols) < n
    assert back.all_ids().tolist() == [x for d in docs for x in [*d.tolist(), 0]]
    for i, d in enumerate(docs):
        whole = [*d.tolist(), 0]
        assert back.ids(i).tolist() == whole
        for a, b in ((0, 1), (1, 7), (100, 4000), (8999, 9001), (3, 3)):
            assert back.ids(i, a, b).tolist() == whole[a:b]


def test_query_against_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id"), (-(1 << 63), "least id")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string")
    path = common.new_path(spark, "t")
    repair.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), block_ids=50)
    got = repair.read_token_files(spark, path, digest=True).orderBy("start").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    null = -(1 << 64)
    want = sorted((null if d is None else d, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, t in rows)
    assert sorted((null if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: null if d is None else d)
    assert sum(r.doc_id is None for r in got) == 1
    for r in got:
        assert r.start == start
        start += r.n_tokens
    repair.write_token_files(docs.limit(0), path + "-none", public_tokenizers.path("byte_bpe_50k.json"))
    assert repair.read_token_files(spark, path + "-none").count() == 0
