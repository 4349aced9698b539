"""Hashes of the words of many texts at once, over the bytes of an Arrow string array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial over bytes and of that over words.
BYTE_BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Bytes hashed together, unless a text alone is longer. Work memory is about 40 times as much.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BYTE_BASE)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(base: np.uint64) -> np.uint64:
    x = int(base)
    for _ in range(6):
        x = x * (2 - int(base) * x) % (1 << 64)
    return U(x)


BYTE_INVERSE = _inverse(BYTE_BASE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array, size: int = CHUNK):
    """(first, after last) of consecutive runs of texts of about ``size`` bytes."""
    _, offsets = raw(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none), and where each begins and the last ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(texts):
        return whole[:0], np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word (bytes outside white space)."""
    n = len(data)
    space = _SPACE[data]
    before, after = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
    before[1:], after[: max(n - 1, 0)] = space, space[1:]
    before[offsets] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    start, end = np.flatnonzero(before[:n] & ~space), np.flatnonzero(after[:n] & ~space) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, from which ``span`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(BYTE_BASE, len(data)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, wherever it lies."""
    back = powers(BYTE_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * back[start])


def shingles(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``k`` words; a text of fewer words is one shingle."""
    n = len(words)
    if not n:
        return words, owner
    scale = powers(WORD_BASE, k)
    out, whose = [], []
    if n >= k:
        total = words[: n - k + 1] * scale[0]
        for j in range(1, k):
            total += words[j : n - k + 1 + j] * scale[j]
        inside = owner[: n - k + 1] == owner[k - 1 :]
        out.append(total[inside])
        whose.append(owner[: n - k + 1][inside])
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(first, append=n)
    for m in range(1, k):
        at = first[count == m]
        if len(at):
            total = words[at] * scale[0]
            for j in range(1, m):
                total = total + words[at + j] * scale[j]
            out.append(total + U(m))
            whose.append(owner[at])
    return mix(np.concatenate(out)), np.concatenate(whose)
