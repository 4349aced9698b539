"""Encoding of whole texts with the tokenizers library, one library call per distinct word.

Words repeat far more often than texts do, so ids are remembered per word (bounded memory). Texts
are cut only where that provably leaves the ids unchanged. ``WordMemo`` takes one text at a time and
gives those that it can't cut to the library whole; ``PieceTable`` takes many texts at a time and cuts
each where it can.
"""

from __future__ import annotations

import re
import string
import sys
import threading
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np

_LOCAL = threading.local()
#: Texts with other characters, or with runs of white space, are encoded whole.
_ODD = re.compile("[^\n\x20-\x7e¡-¬®-ɏ]")
_RUNS = ("  ", " \n", "\n ", "\n\n")
_MARKS = string.punctuation
#: A comma or full stop that does not begin a run of marks right after a word.
_INNER = re.compile("[^A-Za-z0-9À-ÖØ-öø-ɏ][,.]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on in ascending order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordMemo(dict):
    """Word -> its ids as little-endian 16-bit numbers.

    spaced: whether a blank before a word belongs to the word (byte-level vocabularies), or
    white space is dropped and letters are lower-cased. limit: remembered words at most.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        #: Texts that may hold an added token (in any case of letters) are encoded whole.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.heads = {x for c in added for x in (c[0], c[0].lower(), c[0].upper())}
        self.model, self.spaced, self.code, self.limit = self.tok.model, spaced, "H", limit
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids don't fit in 16 bits")
        self.letters = _byte_letters()
        self.blank = self.letters[0x20] if spaced else ""
        self.marks: dict[str, bytes] = {}
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def letters_only(self, word: str, blank: str) -> bytes | None:
        """Ids of a run of letters by the vocabulary's merges alone; None where it isn't one."""
        if not (word.isalpha() and (self.spaced or word.lower().isalpha())):
            return None
        raw = (word if self.spaced else word.lower()).encode()
        piece = blank + (raw.decode() if raw.isascii() else raw.decode("latin-1").translate(self.letters))
        return self.pack([x.id for x in self.model.tokenize(piece)])

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)  # much quicker than numpy for a few numbers
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, word: str) -> bytes:
        head = word.rstrip(_MARKS)
        if head is not word and head.isalpha():  # marks after letters are a piece of their own
            tail = word[len(head) :]
            if (end := self.marks.get(tail)) is None:
                end = self.whole(tail)
                if len(self.marks) < self.limit:
                    self.marks[tail] = end
            return self[head] + end
        if self.spaced and word[:1] == "\n":  # so is a line feed before what isn't white space
            if (ids := self.letters_only(word[1:], "")) is None:
                ids = self.whole(word)
            else:
                ids = self.feed + ids
        elif word[0] in ",.":  # right after a word: ``encode`` has set them apart
            ids = self.whole(word)
        elif (ids := self.letters_only(word, self.blank)) is None:
            ids = self.whole(" " + word if self.spaced else word)
        if len(self) < self.limit:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, none added to it, as little-endian 16-bit numbers."""
        if not text:
            return b""
        if _ODD.search(text) or text[-1] in " \n" or any(run in text for run in _RUNS):
            return self.whole(text)
        if any(c in text for c in self.heads) and self.added.search(text):
            return self.whole(text)
        if not _INNER.search(text):
            text = text.replace(",", " ,").replace(".", " .")  # then "word," is looked up as two known words
        elif " ," in text or " ." in text:
            return self.whole(text)
        if not self.spaced:
            return b"".join(map(self.__getitem__, text.split()))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.__getitem__, rest))


#: What a byte is to the cuts of a text: a letter or digit, a mark or white space; of others nothing is assumed.
_WORD, _MARK, _WHITE = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[b for b in range(128) if chr(b).isalnum()]] = _WORD
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE


def _cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of UTF-8 text: whether the pattern of byte-level vocabularies provably begins a
    piece there, and whether it belongs to a letter that is known as such.

    No piece holds white space after anything else, and a mark after a letter or digit begins a piece,
    so the characters on both sides decide. A single line feed is a piece of its own. U+00C0 to U+023F
    are letters but for two signs, and there is no white space from there to U+07FF. What the pattern
    looks ahead at is never beyond one of these cuts.
    """
    kind = _KIND[raw]
    letter = (kind == _WORD) & (raw > 0x39)
    solid = (kind == _WORD) | (kind == _MARK)  # known not to be white space
    two = np.flatnonzero((raw >= 0xC3) & (raw < 0xE0))  # first bytes of characters of two
    solid[two + 1] = True
    two = two[(raw[two] < 0xC9) & ((raw[two] > 0xC3) | (raw[two + 1] & 0xDF != 0x97))]
    letter[two] = letter[two + 1] = True
    kind[two + 1] = _WORD
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = (kind[1:] == _WHITE) & solid[:-1] | (kind[1:] == _MARK) & (kind[:-1] == _WORD)
    feed = np.flatnonzero(raw[1:-1] == 10) + 1
    feed = feed[solid[feed - 1] & (solid[feed + 1] | (raw[feed + 1] >= 0xC3) & (raw[feed + 1] < 0xE0))]
    cut[feed + 1] = True
    return cut, letter


class PieceTable:
    """Ids of many texts at a time, for byte-level vocabularies: texts are cut where the library cuts
    them too, and the library is called once for each distinct piece.

    Pieces of up to 15 bytes are numbered by a hash table in arrays, which is searched for all pieces
    of a chunk at once and holds whole pieces, so equal hashes do no harm; longer ones lie in a
    dictionary. limit: remembered pieces at most, and LONG longer ones; others are encoded once in each chunk.
    """

    SHORT = 15  # bytes; the last of 16 holds the length
    LONG = 50_000
    CHUNK = 1 << 20  # characters of text
    MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

    def __init__(self, path: str, limit: int = 1_000_000, bits: int = 21):
        self.words = WordMemo(path, True)
        self.bits, self.limit = bits, min(limit, 1 << bits - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.n = 0
        self.low, self.high = np.zeros(self.limit + 1, np.uint64), np.zeros(self.limit + 1, np.uint64)  # the bytes of each piece, and its length
        self.upto = np.zeros(1 << 12, np.int64)  # where the ids of each piece begin, and those of the last end
        self.ids = np.zeros(1 << 12, np.uint16)
        self.long: dict[bytes, list[int]] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, none added to it, as little-endian 16-bit numbers."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= self.CHUNK:
                yield from self._chunk(some)
                some, size = [], 0
        yield from self._chunk(some)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        added, heads = self.words.added, self.words.heads
        odd = {i: self.words.whole(x) for i, x in enumerate(texts) if any(c in x for c in heads) and added.search(x)}
        parts = [b"" if i in odd else x.encode() for i, x in enumerate(texts)]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        total = int(bounds[-1])
        whole = b"".join([*parts, bytes(16)])
        raw = np.frombuffer(whole, dtype=np.uint8)
        cut, letter = _cuts(raw[:total])
        cut[bounds[bounds < total]] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=total)
        number = self._numbers(whole, start, size, letter)
        n = self.upto[number + 1] - self.upto[number]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.upto[number] - upto[:-1], n) + np.arange(upto[-1])].astype("<u2").tobytes()
        ends = (2 * upto[np.searchsorted(start, bounds)]).tolist()
        return [odd[i] if i in odd else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]

    def _find(self, low: np.ndarray, high: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1; ``slot`` moves to where it is or would be."""
        found = self.slots[slot]
        left = np.flatnonzero((found >= 0) & ((self.low[found] != low) | (self.high[found] != high)))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            found[left] = now = self.slots[slot[left]]
            left = left[(now >= 0) & ((self.low[now] != low[left]) | (self.high[now] != high[left]))]
        return found

    def _numbers(self, whole: bytes, start: np.ndarray, size: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The number of each piece. Numbers from ``self.n`` on hold for this chunk only."""
        eight = np.ndarray(len(whole) - 7, dtype="<u8", buffer=whole, strides=(1,))
        low = eight[start] & self.MASK[np.minimum(size, 8)]
        high = eight[start + 8] & self.MASK[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        slot = ((low ^ high * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        number = self._find(low, high, slot)
        long = np.flatnonzero(size > self.SHORT)
        number[long] = 0
        new = np.flatnonzero(number < 0)
        new = new[np.lexsort((low[new], high[new]))]
        a, b = low[new], high[new]
        first = np.ones(len(new), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        number[new] = self.n + np.cumsum(first) - 1
        new = new[first]
        seen = np.zeros(len(letter) + 1, dtype=np.int32)
        np.cumsum(letter, out=seen[1:])
        ids = self._library(whole, start[new], size[new], seen)
        places: dict[bytes, list[int]] = {}
        for i, a, n in zip(long.tolist(), start[long].tolist(), size[long].tolist()):
            places.setdefault(whole[a : a + n], []).append(i)
        unknown = np.array([at[0] for piece, at in places.items() if piece not in self.long], dtype=np.int64)
        made = iter(self._library(whole, start[unknown], size[unknown], seen))
        for piece, at in places.items():
            number[at] = self.n + len(ids)
            ids.append(self.long[piece] if piece in self.long else next(made))
            if len(piece) <= 64 and len(self.long) < self.LONG:
                self.long[piece] = ids[-1]
        self._append(ids, low[new], high[new], slot[new])
        return number

    def _library(self, whole: bytes, start: np.ndarray, size: np.ndarray, seen: np.ndarray) -> list[list[int]]:
        """The library's ids of each piece; ``seen``: bytes of letters before each byte."""
        letters = seen[start + size] - seen[start]
        blank = np.frombuffer(whole, dtype=np.uint8)[start] == 0x20
        plain = (letters > 0) & (letters + blank == size)  # one piece of the pattern: by the vocabulary's merges alone
        pieces = [whole[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]
        stand = self.words.letters
        named = iter(b"\n".join(compress(pieces, plain)).decode("latin-1").translate(stand).split(stand[10]))
        merge, encode = self.words.model.tokenize, self.words.tok.encode
        return [[x.id for x in merge(next(named))] if simple else encode(piece.decode(), add_special_tokens=False).ids for piece, simple in zip(pieces, plain.tolist())]

    def _append(self, ids: list[list[int]], low: np.ndarray, high: np.ndarray, slot: np.ndarray) -> None:
        """Adds ids of pieces; the first of them, of which low and high are given, are remembered as far as there is room."""
        flat, counts = list(chain.from_iterable(ids)), list(map(len, ids))
        end = int(self.upto[self.n])
        while len(self.upto) <= self.n + len(counts):
            self.upto = np.concatenate((self.upto, np.zeros_like(self.upto)))
        while len(self.ids) < end + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.upto[self.n + 1 : self.n + 1 + len(counts)] = end + np.cumsum(counts)
        self.ids[end : end + len(flat)] = flat
        kept = min(len(low), self.limit - self.n)
        self.low[self.n : self.n + kept], self.high[self.n : self.n + kept] = low[:kept], high[:kept]
        number, slot = np.arange(self.n, self.n + kept, dtype=np.int32), slot[:kept]
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            lost = self.slots[slot] != number
            number, slot = number[lost], (slot[lost] + 1) & (len(self.slots) - 1)
        self.n += kept


def memo(path: str, spaced: bool) -> WordMemo:
    """The encoder of this Python worker for a vocabulary file."""
    return _kept(WordMemo, path, spaced)


def piece_table(path: str) -> PieceTable:
    """The encoder of many texts at a time of this Python worker for a byte-level vocabulary file."""
    return _kept(PieceTable, path)


def _kept(kind: type, *args):
    known = _LOCAL.__dict__.setdefault("memos", {})
    if (kind, *args) not in known:
        known.clear()
        known[kind, *args] = kind(*args)
    return known[kind, *args]
