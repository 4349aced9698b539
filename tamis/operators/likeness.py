"""Likeness of names by matching blocks (as difflib counts them), for one name against many at once.

The longest common run of two names, then those of what is left of it and right of it on both sides,
and so on; twice their length over the length of both names. Runs are found for hundreds of pairs
together: one step of the usual table for each character of the left name, over all of the right
names' characters. Pairs whose bound (what is matched already, and the shorter of each two parts that
are still open) falls below what is asked for are given up on the way.
"""

from __future__ import annotations

import difflib
import os
from collections import Counter

import numpy as np

#: From this length on difflib passes over characters that a right name has often; such names go to it.
LONG = 200
#: Cells of one table at most.
CELLS = 1 << 20
#: Buckets by which pairs of neighbouring letters are counted.
PAIRS = 256


#: Kinds of characters up to which the places of each are kept as bits, and how many places a word has (the bit left over
#: carries); pairs whose common subsequences are told together.
KINDS, DIGIT, TOGETHER = 128, 63, 4096
#: Right names of one left name from which they are looked at apart from those of others.
FEW = 1500


def _code_points(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of all names, and which name each is of."""
    return np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64), np.repeat(np.arange(len(names)), [len(x) for x in names])


def letters(names: list[str]) -> np.ndarray:
    """How often each name has each character, by code point modulo 64."""
    c, owner = _code_points(names)
    return np.bincount(owner * 64 + c % 64, minlength=64 * len(names)).astype(np.int32).reshape(-1, 64)


def _levels(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as ones, one for each level up to ``most``: products of such rows are sums of the lesser counts."""
    kind = np.repeat(np.arange(len(most)), most)
    level = np.arange(len(kind)) - np.repeat(np.cumsum(most) - most, most)
    return (counts[:, kind] > level).astype(np.float32)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of columns the longest common run: its length and where it begins on either side;
    of several the first on the left, and of these the first on the right. Padding of both differs."""
    n = a.shape[1]
    size, at_a, at_b = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    run, new = np.zeros((b.shape[0] + 1, n), dtype=np.uint8), np.zeros((b.shape[0] + 1, n), dtype=np.uint8)
    for i in range(a.shape[0]):
        np.add(run[:-1], 1, out=new[1:])
        np.multiply(new[1:], b == a[i], out=new[1:])
        run, new = new, run
        most = run.max(axis=0)
        better = np.flatnonzero(most > size)
        if len(better):
            size[better] = most[better]
            at_a[better] = i + 1 - most[better].astype(np.int64)
            at_b[better] = run[:, better].argmax(axis=0) - most[better].astype(np.int64)
    return size.astype(np.int64), at_a, at_b


def matched(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of column ``left`` of ``a`` with column ``right`` of ``b``, for each pair; -1
    where they are certainly below ``needed``. The sizes say how many rows of a column count."""
    n = len(left)
    total, gone = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    owner, a0, a1, b0, b1 = np.arange(n), np.zeros(n, np.int64), size_a.astype(np.int64), np.zeros(n, np.int64), size_b.astype(np.int64)
    while True:
        wide_a, wide_b = a1 - a0, b1 - b0
        most = np.maximum(np.minimum(wide_a, wide_b), 0)
        gone |= total + np.bincount(owner, weights=most, minlength=n).astype(np.int64) < needed
        keep = np.flatnonzero((most > 0) & ~gone[owner])
        if not len(keep):
            return np.where(gone, -1, total)
        # Parts of like shape share a table, all small ones one.
        shape = np.maximum(np.ceil(np.log2(wide_a[keep])), 3).astype(np.int64) * 16 + np.maximum(np.ceil(np.log2(wide_b[keep])), 3).astype(np.int64)
        order = np.argsort(shape, kind="stable")
        keep, shape = keep[order], shape[order]
        nexts = []
        for low, high in zip(*(lambda cut: (cut, np.append(cut[1:], len(keep))))(np.flatnonzero(np.append(True, shape[1:] != shape[:-1])))):
            step = max(1, CELLS // int(wide_b[keep[low:high]].max()))
            for k in range(low, high, step):
                part = keep[k : min(high, k + step)]
                o, x0, x1, y0, y1 = (v[part] for v in (owner, a0, a1, b0, b1))
                ii, jj = np.arange((x1 - x0).max())[:, None], np.arange((y1 - y0).max())[:, None]
                mine = np.where(ii < x1 - x0, a[np.minimum(x0 + ii, len(a) - 1), left[o]], a.dtype.type(0))
                theirs = np.where(jj < y1 - y0, b[np.minimum(y0 + jj, len(b) - 1), right[o]], b.dtype.type(1))
                size, i, j = _longest(mine, theirs)
                np.add.at(total, o, size)
                some = size > 0
                o, x0, x1, y0, y1, size, i, j = (v[some] for v in (o, x0, x1, y0, y1, size, x0 + i, y0 + j))
                nexts += [(o, x0, i, y0, j), (o, i + size, x1, j + size, y1)]
        owner, a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*nexts))


def _pairs_of_letters(names: list[str]) -> np.ndarray:
    c, owner = _code_points(names)
    own = owner[1:] == owner[:-1]
    pairs = (c[1:] * 31 + c[:-1] * 7) % PAIRS
    return np.minimum(np.bincount((owner[1:] * PAIRS + pairs)[own], minlength=PAIRS * len(names)), 255).astype(np.uint8).reshape(-1, PAIRS)


def _codes(names: list[str], known: np.ndarray, kind: type) -> np.ndarray:
    """A column for each name: its characters' places among the ``known`` ones, from 2 on; 0 for others and as padding."""
    out = np.zeros((max(map(len, names), default=0) + 1, len(names)), dtype=kind)
    c, owner = _code_points(names)
    if len(c) and len(known):
        at = np.minimum(np.searchsorted(known, c), len(known) - 1)
        first = np.cumsum([0, *map(len, names)])[owner]
        out[np.arange(len(c)) - first, owner] = np.where(known[at] == c, at + 2, 0)
    return out


def _places(codes: np.ndarray, sizes: np.ndarray, kinds: int) -> np.ndarray:
    """For each DIGIT characters, each kind of character and each name (a column of ``codes``) the bits of its places."""
    digits = -(-int(sizes.max(initial=1)) // DIGIT)
    out = np.zeros((digits, kinds, codes.shape[1]), dtype=np.uint64)
    for k in range(min(len(codes), digits * DIGIT)):
        some = np.flatnonzero(sizes > k)
        out[k // DIGIT, codes[k, some], some] |= np.uint64(1 << k % DIGIT)
    return out


def _zeros(n: int, size: int, steps) -> np.ndarray:
    """How many zeros are left in each of ``size`` numbers of ``n`` words, all ones at first; ``steps`` gives the places of one
    character after another, an array for each word."""
    low_bits = ~np.uint64(0) >> np.uint64(64 - DIGIT)
    left = [np.full(size, low_bits) for _ in range(n - 1)] + [np.full(size, ~np.uint64(0))]
    u, v, over = (np.zeros(size, dtype=np.uint64) for _ in range(3))
    for places in steps:
        for d in range(n):
            x = left[d]
            np.bitwise_and(x, places[d], u)
            np.subtract(x, u, v)
            np.add(x, u, u)
            if d:
                np.add(u, over, u)
            if d < n - 1:
                np.right_shift(u, DIGIT, over)
                np.bitwise_or(u, v, u)
                np.bitwise_and(u, low_bits, x)
            else:
                np.bitwise_or(u, v, x)
    return sum(np.bitwise_count(~x & low_bits).astype(np.int64) for x in left)


class Names:
    """Left and right names, ready to be compared with each other."""

    def __init__(self, left: list[str], right: list[str]):
        self.left, self.right = left, right
        self.size_a, self.size_b = (np.array([len(x) for x in names], dtype=np.int64) for names in (left, right))
        self.letters_a, self.letters_b = letters(left), letters(right)
        self.pairs_a, self.pairs_b = _pairs_of_letters(left), _pairs_of_letters(right)
        # Characters by number, from 2 on (0 and 1 are padding): in one byte where they are few.
        self.short = np.flatnonzero(self.size_b < LONG)
        known, self.codes_b = np.zeros(0, np.int64), [right[i] for i in self.short]
        if self.codes_b:
            known = np.unique(_code_points(self.codes_b)[0])
        kind = np.uint8 if len(known) < 250 else np.uint32
        self.codes_a, self.codes_b = (_codes(names, known, kind) for names in (left, self.codes_b))
        # The places of each character, and the sums that bound ratios.
        self.bits = _places(self.codes_b, self.size_b[self.short], len(known) + 2) if len(known) + 2 <= KINDS else None
        most = np.minimum(self.letters_a.max(axis=0, initial=0), self.letters_b.max(axis=0, initial=0))
        self.levels_a, self.levels_b = _levels(self.letters_a, most), _levels(self.letters_b, most).T
        self.column = np.full(len(right), -1)
        self.column[self.short] = np.arange(len(self.short))
        # Of a long name difflib looks for the characters that it has seldom.
        self.seldom: dict[int, frozenset[str]] = {}

    def bounds(self, i: int) -> np.ndarray:
        """What the ratios of left name ``i`` can be at most: the shared letters over all letters."""
        return 2 * np.minimum(self.letters_b, self.letters_a[i]).sum(axis=1) / np.maximum(self.size_b + self.size_a[i], 1)

    def bounds_of(self, some: range) -> np.ndarray:
        """``bounds`` of the left names ``some``, a row for each, as 32-bit numbers (so up to a millionth off)."""
        some = slice(some.start, some.stop)
        out = self.levels_a[some] @ self.levels_b
        out *= 2
        out /= np.maximum(self.size_b + self.size_a[some, None], 1)
        return out

    def common(self, i: int, j: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence, which no matching blocks exceed, of left name ``i`` with each of the
        right names ``j`` (short ones, where there are bits): the number of zeros left in words of ones, a bit for each
        character of the right name, by the usual steps for each character of the left one."""
        out = np.zeros(len(j), dtype=np.int64)
        own = self.codes_a[: self.size_a[i], i]
        kinds, steps = np.unique(own[own > 1], return_inverse=True)
        if not len(kinds):
            return out
        digits = -(-self.size_b[j] // DIGIT)
        for n in np.unique(digits).tolist():
            at = np.flatnonzero(digits == n)
            for low in range(0, len(at), TOGETHER):
                part = at[low : low + TOGETHER]
                held = self.column[j[part]]
                table = [[self.bits[d, k].take(held) for k in kinds] for d in range(n)]
                out[part] = _zeros(n, len(part), ([table[d][k] for d in range(n)] for k in steps.tolist()))
        return out

    def common_of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``common`` of each left name ``i`` with the right name ``j`` beside it: for many left names with few right ones each."""
        out = np.zeros(len(j), dtype=np.int64)
        digits = -(-self.size_b[j] // DIGIT)
        for n in np.unique(digits).tolist():
            at = np.flatnonzero(digits == n)
            at = at[np.argsort(self.size_a[i[at]], kind="stable")]
            for low in range(0, len(at), TOGETHER):
                part = at[low : low + TOGETHER]
                column, held, width = i[part], self.column[j[part]], len(self.short)
                places = (self.codes_a[k, column].astype(np.int64) * width + held for k in range(int(self.size_a[column].max())))
                out[part] = _zeros(n, len(part), ([self.bits[d].ravel().take(x) for d in range(n)] for x in places))
        return out

    def ceilings(self, todo: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """What the ratios of left names with right ones can be at most: of each (left, right ones, bounds) these bounds, or less
        by common subsequences."""
        out = [bound.astype(np.float64) for _, _, bound in todo]
        if self.bits is None:
            return out
        short = [np.flatnonzero(self.size_b[j] < LONG) for _, j, _ in todo]
        few = [k for k, x in enumerate(short) if 0 < len(x) < FEW]
        if few:
            found = self.common_of(np.repeat([todo[k][0] for k in few], [len(short[k]) for k in few]), np.concatenate([todo[k][1][short[k]] for k in few]))
            known = dict(zip(few, np.split(found, np.cumsum([len(short[k]) for k in few])[:-1])))
        for k, (i, j, _) in enumerate(todo):
            if len(short[k]):
                right = j[short[k]]
                out[k][short[k]] = 2 * (known[k] if len(right) < FEW else self.common(i, right)) / np.maximum(self.size_a[i] + self.size_b[right], 1)
        return out

    def ratios(self, i: np.ndarray, j: np.ndarray, least: np.ndarray, bounded: bool = False) -> np.ndarray:
        """difflib's ratios of left names ``i`` with right names ``j``; -1 where one is certainly below its ``least``.
        ``bounded``: all ``ceilings`` are known not to be.

        Matching blocks are apart by a character that one side has over, so of m characters in blocks
        of names of s together, 3 m - s - 1 at least have their neighbour in common: above a ratio of
        2/3 the pairs of letters that both have tell most names apart."""
        out = np.full(len(i), -1.0)
        both = self.size_a[i] + self.size_b[j]
        needed = np.ceil(least * both / 2 - 1e-9).astype(np.int64)
        maybe = np.ones(len(i), dtype=bool)
        asked = np.flatnonzero((3 * needed - both - 1 > 0) & (self.size_b[j] < LONG))
        for k in range(0, len(asked), 4096):
            part = asked[k : k + 4096]
            shared = np.minimum(self.pairs_a[i[part]], self.pairs_b[j[part]]).sum(axis=1, dtype=np.int64)
            maybe[part] = shared >= (3 * needed - both - 1)[part]
        short = np.flatnonzero(maybe & (self.size_b[j] < LONG))
        if len(short) and self.bits is not None and not bounded:
            asked = short[needed[short] > 0]
            maybe[asked] = self.common_of(i[asked], j[asked]) >= needed[asked]
            short = short[maybe[short]]
        if len(short):
            found = matched(self.codes_a, self.codes_b, i[short], self.column[j[short]], self.size_a[i[short]], self.size_b[j[short]], needed[short])
            out[short] = np.where(found >= 0, 2.0 * found / np.maximum(both[short], 1), -1.0)
        for k in np.flatnonzero(self.size_b[j] >= LONG).tolist():
            a, b = self.left[i[k]], self.right[j[k]]
            if b not in self.seldom:
                self.seldom[b] = frozenset(c for c, n in Counter(b).items() if n <= len(b) // 100 + 1)
            if not self.seldom[b].isdisjoint(a):
                out[k] = difflib.SequenceMatcher(None, a, b).ratio()
            else:  # only what both begin with is found
                out[k] = 2.0 * len(os.path.commonprefix([a, b])) / (len(a) + len(b))
        return out
