"""Weighted min-wise signatures by BagMinHash (numpy kernel of operator 4).

Every (element, unit of weight) has a Poisson process of points in time, dealt
over the m registers; a register keeps its earliest point among the units that a
text holds.  Two texts' registers agree with probability sum(min) / sum(max) of
their weights.

Weights are discretised to whole numbers.  The units of an element are grouped in
intervals (0, 1], (1, 2], (2, 4], ...: an interval's process is generated as a
whole, and when a point comes the interval is halved: the point goes to one
half, and the other half's process starts at that time.  A process whose next
point lies behind every register of its text ends, so most units are never
looked at.  Points depend on element and interval only, never on the text."""

from __future__ import annotations

import numpy as np

from riskspark.llm.textkernel import BASE, mix, prefix_hash, range_hash, shingles, word_ranges


def text_shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each distinct run of k words; a text of fewer words has one run of all its words."""
    starts, ends, first = word_ranges(data, off)
    words = range_hash(prefix_hash(data), starts, ends)
    hashes, text, _ = shingles(words, first, k)
    count = np.diff(first)
    for j in range(1, k):                        # texts of j words
        short = np.flatnonzero(count == j)
        if len(short):
            acc = words[first[short]]
            for i in range(1, j):
                acc = mix(acc * np.uint64(BASE) + words[first[short] + i])
            hashes = np.concatenate((hashes, mix(acc + np.uint64(j))))
            text = np.concatenate((text, short))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """(texts, m) earliest points; infinite for a text without elements."""
    register = np.full(texts * m, np.inf)
    latest = np.full(texts, np.inf)
    parts = []
    lo, hi = 0, 1
    while len(weight) and lo < weight.max():
        at = np.flatnonzero(weight > lo)
        parts.append((text[at], mix(element[at] ^ mix(np.full(len(at), hi, np.uint64))), weight[at],
                      np.full(len(at), lo), np.full(len(at), hi)))
        lo, hi = hi, 2 * hi
    if not parts:
        return register.reshape(texts, m)
    text, seed, weight, lo, hi = (np.concatenate(x) for x in zip(*parts))
    time, turn, has = np.zeros(len(text)), np.zeros(len(text), np.uint64), np.zeros(len(text), dtype=bool)
    step, side_step, register_step = (np.uint64(x) for x in (BASE, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03))
    while len(text):
        # The next point of processes that have none.
        need = np.flatnonzero(~has)
        bits = mix(seed[need] + turn[need] * step)
        time[need] -= np.log(_uniform(bits)) / (m * (hi[need] - lo[need]))
        has[need] = True
        live = time < latest[text]
        text, seed, weight, lo, hi, time, turn, has = (x[live] for x in (text, seed, weight, lo, hi, time, turn, has))
        leaf = hi - lo == 1
        at = np.flatnonzero(leaf)
        slot = mix(seed[at] + turn[at] * step + register_step) % np.uint64(m)
        np.minimum.at(register, text[at] * m + slot.astype(np.int64), time[at])
        turn[at] += np.uint64(1)
        has[at] = False
        touched = np.unique(text[at])
        latest[touched] = register.reshape(texts, m)[touched].max(axis=1)
        at = np.flatnonzero(~leaf)
        if len(at):
            right = (mix(seed[at] + side_step) >> np.uint64(63)).astype(bool)
            middle = (lo[at] + hi[at]) // 2
            halves = []
            for is_right in (False, True):
                low = np.where(is_right, middle, lo[at])
                held = low < weight[at]
                halves.append((text[at][held], mix(seed[at] * np.uint64(BASE) + np.uint64(1 + is_right))[held],
                               weight[at][held], low[held], np.where(is_right, hi[at], middle)[held], time[at][held],
                               np.zeros(held.sum(), np.uint64), (right == is_right)[held]))
            whole = tuple(x[leaf] for x in (text, seed, weight, lo, hi, time, turn, has))
            text, seed, weight, lo, hi, time, turn, has = (np.concatenate(x) for x in zip(whole, *halves))
    return register.reshape(texts, m)


def band_hashes(registers: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) hashes of ``rows`` neighbouring registers each; 0 for a text without elements."""
    texts, m = registers.shape
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(texts, m // rows, rows)
    acc = mix(np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), (texts, m // rows)).copy())
    for r in range(rows):
        acc = mix(acc * np.uint64(BASE) + bits[:, :, r])
    acc |= np.uint64(1)
    acc[np.isinf(registers[:, 0])] = 0
    return acc


def overlap(a: tuple, b: tuple, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per pair, sum of the smaller and of the larger counts; a and b are (pair, shingle, count) as from text_shingles."""
    ka, kb = (mix(s ^ mix(p.astype(np.uint64) + np.uint64(1))) for p, s, _ in (a, b))
    order = np.argsort(ka)
    place = np.minimum(np.searchsorted(ka[order], kb), max(len(ka) - 1, 0))
    both = np.zeros(pairs)
    if len(ka):
        hit = np.flatnonzero((ka[order][place] == kb))
        both = np.bincount(b[0][hit], np.minimum(a[2][order][place[hit]], b[2][hit]), pairs)
    total = np.bincount(a[0], a[2], pairs) + np.bincount(b[0], b[2], pairs)
    return both, total - both
