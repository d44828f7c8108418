"""Word shingles of whole texts as sorted 64-bit hashes, computed over byte buffers.

Words are runs of ASCII letters, digits, "_" and of bytes from 0x80 on, in lower case (the
caller lower-cases); everything else parts words. A shingle is ``size`` words in a row; a
text of fewer words has one shingle of all of them; a text without words has none.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
for _ranges in ((48, 58), (65, 91), (97, 123), (95, 96), (128, 256)):
    _WORD[slice(*_ranges)] = True
_P = 0x100000001B3
_INVERSE = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, for each text the number of its first word, and the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    powers = np.full(n, _P, np.uint64)
    powers[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers), out=sums[1:])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    hashes = mix((sums[ends] - sums[starts]) * np.cumprod(back)[starts])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending."""
    words, firsts = word_hashes(offsets, data)
    n = len(words)
    lasts = np.repeat(firsts[1:], np.diff(firsts))  # one past each word's text
    at = np.arange(n)
    h = words.copy()
    for k in range(1, size):
        own = np.zeros(n, np.uint64)
        own[: max(0, n - k)] = words[k:]
        own[at + k >= lasts] = 0
        h = h * np.uint64(_P) + own
    h = mix(h)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        out.append(np.unique(h[a : max(b - size + 1, a + 1)]) if b > a else h[:0])
    return out
