"""Words of UTF-8 text as byte spans and 64-bit hashes, whole columns at a time in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
STEPS = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # odd factors by place in a window

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z only
FOLDED = _BYTE[_FOLD]
EXACT = _BYTE

ALNUM = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
GRAPHIC = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
GRAPHIC[[32, 9, 10, 11, 12, 13]] = False

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # index of the first word of each row, and the total

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, letters: np.ndarray = FOLDED) -> Words:
    """Words of each row: maximal runs of bytes of ``kind``; never across rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    inside = kind[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * power[: len(data)], out=total[1:])
    return Words(start, end, mix((total[end] - total[start]) * inverse[start]), np.searchsorted(start, bounds))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (``len - k + 1`` of them, without regard to rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j: j + n] * STEPS[j]
    return mix(out + np.uint64(k))


def windows_in_rows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every ``k``-word window that lies in one row."""
    hashes = window_hashes(words.hash, k)
    row = words.row
    inside = row[: len(hashes)] == row[k - 1:] if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    return at, hashes[at]
