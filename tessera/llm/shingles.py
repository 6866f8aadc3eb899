"""Hashes of words and word shingles as arrays, the same in every process."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import BLANKS

_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_BYTE[_BLANK] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once; longer texts go in parts that end at a blank.
PART = 1 << 22
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (a bijection of 64-bit integers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a text, in order; fold lower-cases A-Z."""
    if len(text) > PART:
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + PART)
            while end < len(text) and text[end] not in BLANKS:
                end += 1
            parts.append(_hashes(text[at:end], fold))
            at = end
        return np.concatenate(parts)
    return _hashes(text, fold)


def _hashes(text: bytes, fold: bool) -> np.ndarray:
    global _powers
    b = np.frombuffer(text.lower() if fold else text, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    blank = _BLANK[b]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(b)))
    longest = int(lengths.max())
    if longest > len(_powers):
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, _BASE, np.uint64)]))
    inside = np.arange(starts[0], len(b)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_BYTE[b[starts[0] :]] * _powers[inside], starts - starts[0]))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; of the whole sequence where there are fewer."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out += words[j : n - width + 1 + j] * _STEP[j]
    return mix(out)
