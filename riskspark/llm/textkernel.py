"""Vectorised hashing of byte ranges and words (numpy, no Spark).

A polynomial prefix hash modulo 2**64 over a block of bytes gives the hash of
any range with two lookups; word and shingle hashes are built from it."""

from __future__ import annotations

import numpy as np

# An odd multiplier, its inverse modulo 2**64, and the constants of the splitmix64 finaliser.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        run = np.full(size, base, dtype=np.uint64)
        run[0] = 1
        have = np.multiply.accumulate(run)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums P with P[e] - P[s] = hash of data[s:e] times BASE**s."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hash of each range; equal bytes give equal values wherever they stand."""
    raw = (prefix[end] - prefix[start]) * _power(BASE_INV, len(prefix))[start]
    return mix(raw ^ (end - start).astype(np.uint64) * np.uint64(MIX[0]))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """``range_hash`` of the k bytes from each place on (k is at most the length of ``data``)."""
    prefix = prefix_hash(data)
    raw = prefix[k:] - prefix[:-k]
    raw *= _power(BASE_INV, len(raw))
    raw ^= np.uint64(k * MIX[0] % (1 << 64))
    return mix(raw)


# The bytes that part words, 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_ranges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of each text and one past the last)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(off), dtype=np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text, index of the first word) of every run of k words inside one text."""
    n = len(words) - k + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[k - 1:])
    acc = words[at]
    for j in range(1, k):
        acc = mix(acc * np.uint64(BASE) + words[at + j])
    return acc, text[at], at
