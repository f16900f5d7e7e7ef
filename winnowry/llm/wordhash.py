"""Words and their hashes for whole Arrow batches, without a Python object for each word.

A word is a run of bytes other than space and 0x09-0x0D, after A-Z became a-z.  Its hash is
a polynomial over random byte values modulo 2**64, read off a prefix sum and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII punctuation separates words too.
PLAIN = _SPACE.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, doubled up to the length needed."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = max(SLICE_BYTES + 1, 1 << (n - 1).bit_length())
        p = np.ones(size, np.uint64)
        k = 1
        while k < size:
            m = min(k, size - k)
            p[k : k + m] = p[:m] * np.uint64(pow(base, k, 2**64))
            k += m
        if size <= 1 << 24:
            _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the place of each; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's words begin (one more entry), and the words' byte ranges.

    ``space`` marks the bytes that are no part of a word; ``lower`` False keeps capitals apart.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), z, z
    low = _LOWER[data] if lower else data
    word = ~space[low]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[low] * _power(_BASE, n), out=total[1:])
    h = (total[e] - total[s]) * _power(_INVERSE, n)[s]
    return mix(h + (e - s).astype(np.uint64)), np.searchsorted(s, at), s, e


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 entries are not shingles of k words."""
    out = np.zeros(len(h), np.uint64)
    for j in range(k):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - j)] = h[j:]
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + part)
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text is one shingle, one without words none."""
    h, first, _, _ = words(data, at)
    g = shingles(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for v in h[a:b]:
                x = mix(x * np.uint64(0x9FB21C651E98DF25) + v)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
