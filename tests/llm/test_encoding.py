import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tamis.llm import encoding, repair

from .test_repair import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Letters, digits, marks, contractions, all kinds of white space, and characters about which the cuts assume nothing or must not.
BITS = [*"abcXYZ019 \n\t\r\x0b\x0c.,;:'\"!?-_<|>/()#", " ", " ", "\n", "'s", "'ll", "'S", "é", "ß", "Ÿ", "×", "÷", "ǀ", "ȿ", "ɏ", "ª", "²", "\xa0", "\x85", "\xad", "\x1c", "\x1f", "\x00", "\x7f", "́", "٠", "я", "֊", "۝", "߿", " ", "᠎", " ", " ", "​", "　", "中", "ﬁ", "🙂", "the", "wordpiece", "internationalization", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u2").tolist()


@pytest.mark.parametrize("limit,bits,chunk", [(1_000_000, 21, 1 << 20), (60, 7, 100), (0, 4, 1)])
def test_pieces_equal_library(spark, tok, limit, bits, chunk):
    """Also where slots collide, the table is full, and chunks are small."""
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD[1:]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    table = encoding.PieceTable(PATH, limit, bits)
    table.CHUNK = chunk
    for _ in range(2):
        got = list(table.encode(x or "" for x in texts))
        assert len(got) == len(texts)
        for text, raw in zip(texts, got):
            assert ids(raw) == tok.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert table.n <= table.limit <= 1 << bits - 1 and list(table.encode([])) == [] and list(table.encode([""])) == [b""]


def test_every_pair_of_characters_at_a_cut(tok):
    """Each character that the cuts know of (to U+07FF), and some beyond, beside white space, marks and letters."""
    table = encoding.PieceTable(PATH)
    texts = [f"a{chr(c)}{x}b{x}{chr(c)}{x}{x}" for c in [*range(0x800), 0x1680, 0x2009, 0x3000, 0xFB01] for x in (" ", "\n", "\t", ",", "'", "a")]
    assert [ids(x) for x in table.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_one_library_call_for_each_distinct_piece():
    """Texts with runs of white space, quoted commas and other scripts are cut as well: they went to the library whole, each time."""

    class Counting:
        def __init__(self, inner):
            self.inner, self.calls = inner, []

        def encode(self, text, **k):
            self.calls.append(text)
            return self.inner.encode(text, **k)

        def tokenize(self, text):
            self.calls.append(text)
            return self.inner.tokenize(text)

    table = encoding.PieceTable(PATH)
    words = table.words
    words.tok, words.model = Counting(words.tok), Counting(words.model)
    texts = [f'one  two\n\nthree "four", five.  {x} слово\tsix ' for x in ("seven", "eight")] * 500
    list(table.encode(texts))
    assert len(words.tok.calls + words.model.calls) <= 16
    list(table.encode(texts))
    assert len(words.tok.calls + words.model.calls) <= 16


def test_few_places_are_replaced_as_many_are():
    """A round that replaces few pairs of a long block gives what counting all pairs afresh gives."""
    rng = np.random.default_rng(2)
    for n in (40, 400, 4000):
        seq = rng.integers(0, 30, n)
        ends = np.unique(np.append(rng.integers(0, n, 5), n - 1))
        pairs = repair._Pairs(seq, ends)
        inside = np.flatnonzero((pairs.seq[:-1] != repair.END) & (pairs.seq[1:] != repair.END))
        for at in (inside[:1], inside[::7][: n // 40], inside[::2][np.diff(inside[::2], prepend=-9) > 1]):
            pairs = repair._Pairs(seq, ends)
            others = np.sort(rng.choice(n - 1, n // 3, replace=False))
            want = pairs.seq.copy()
            want[at] = 100 + np.arange(len(at))
            changed = np.setdiff1d(np.concatenate((at - 1, at)), [-1, *(at + 1)])
            left = np.setdiff1d(np.union1d(others, changed), at + 1)
            got = pairs.replace(at, 100 + np.arange(len(at)), others)
            want = np.delete(want, at + 1)
            assert pairs.seq.tolist() == want.tolist() and got.tolist() == (left - np.searchsorted(at + 1, left)).tolist()
            again = repair._Pairs(want, np.flatnonzero(want == repair.END))
            assert pairs.slot.tolist() == again.slot.tolist() and pairs.count.tolist() == again.count.tolist()
