"""Words of many texts at once: positions and 64-bit hashes, with numpy over the UTF-8 bytes.

A hash is a polynomial over random byte values, taken from prefix sums, so no word becomes a Python
object. The final mixing makes all 64 bits usable. Everything is fixed by the constants below: equal
words have equal hashes in every task and every run.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = np.random.RandomState(20240501).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64)
_LOWER = _VALUES.copy()
_LOWER[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x):
    """Spread every bit over all 64 (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data, offsets):
    """Begin and end of every word; no word crosses from one text into the next."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data, begins, ends, lower: bool):
    """A hash per span of bytes; with ``lower``, A-Z count as a-z."""
    if not len(begins):
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _VALUES)[data] * power[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64) * _STEP)


def shingles(words, k: int):
    """Hash of each run of ``k`` words; of fewer words, the whole run as one."""
    n = min(k, len(words))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _BASE + words[i : len(words) - n + 1 + i])
    return out
