"""Word shingles of whole texts as sets of 64-bit hashes, in numpy over the bytes of many rows at once."""

from __future__ import annotations

import numpy as np

from gaugeworks.llm.common import mix64

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_PLACE = np.zeros(0, np.uint64)


def _place(n: int) -> np.ndarray:
    """n multipliers, one for each place in a word; the same in every process."""
    global _PLACE
    if len(_PLACE) < n:
        at = np.arange(1, max(n, 64) + 1, dtype=np.uint64)
        _PLACE = mix64(at * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _PLACE[:n]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than blanks, A-Z lower-cased) and, for each row, where its words begin."""
    n = len(raw)
    space = _SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    rows = off[:-1][off[:-1] < off[1:]]
    start[rows] = ~space[rows]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    lengths = np.diff(starts, append=n)
    place = np.arange(starts[0], n) - np.repeat(starts, lengths)
    value = _BYTE[raw[starts[0] :]] * _place(int(place.max()) + 1)[place]
    sums = np.add.reduceat(value, starts - starts[0])
    # blanks count for nothing, so a word of a row's end does not run on; the next row's word has a start of its own
    return mix64(sums), np.searchsorted(starts, off).astype(np.int64)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes; fewer than `width` words make one shingle, none an empty set."""
    words, first = word_hashes(raw, off)
    out: list[np.ndarray] = []
    n = len(words)
    full = np.zeros(0, np.uint64)
    if n >= width:
        full = words[: n - width + 1].copy()
        for j in range(1, width):
            full = full * np.uint64(0x9FB21C651E98DF25) + words[j : n - width + 1 + j]
        full = mix64(full + np.uint64(width))
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(0x9FB21C651E98DF25) + w
            out.append(mix64(np.array([h + np.uint64(1000 + b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
