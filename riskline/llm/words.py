"""Words of UTF-8 texts as 64-bit hashes, computed on whole byte buffers with NumPy.

A word is a run of bytes of a given class; A-Z count as a-z. Both word rules used here are classes of
bytes (every byte of a non-ASCII character is a word byte), so no text is decoded. The hash is a
polynomial over random byte values modulo 2**64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GEN = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _GEN.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_NEXT = _U(0xD6E8FEB86659FD93)
_BLOCK = 1 << 18
_powers: dict[int, np.ndarray] = {}

#: Digits, a-z (A-Z lower-cased) and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _BLOCK + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= _BLOCK + 1:
            _powers[base] = have
    return have[:n]


def find_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each text the index of its first word (n+1 values)."""
    inside = word[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[0] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def hash_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every word, block by block so that memory stays a few MB however long the text is."""
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + _BLOCK, "right")))
        first, last = int(begins[i]), int(ends[j - 1])
        n = last - first
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[first:last]] * _power_table(_BASE, n), out=sums[1:])
        b, e = begins[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[e] - sums[b]) * _power_table(_INVERSE, n)[b] + (e - b).astype(np.uint64))
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (n+1 values)."""
    begins, ends, first = find_words(data, offsets, word)
    return hash_words(data, begins, ends), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each position on (also across texts: the caller leaves those out)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m].copy()
    for k in range(1, n):
        out = out * _NEXT + words[k:k + m]
    return mix(out + _U(n))
