"""Word shingles as 64-bit hashes, computed on whole texts with array operations."""

from __future__ import annotations

import re

import numpy as np

WIDTH = 5
#: Bytes of a text that are hashed at a time; a longer word is taken whole.
PORTION = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ROLL = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse; the tables grow with the longest portion seen."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case, portion by portion."""
    raw, parts, at = text.encode().lower(), [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PORTION)
        end = cut.start() if cut else len(raw)
        parts.append(hashes_of(raw[at:end] if at or cut else raw))
        at = end
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def hashes_of(portion: bytes) -> np.ndarray:
    raw = np.frombuffer(portion, np.uint8)
    visible = np.empty(len(raw) + 2, np.int8)
    visible[0] = visible[-1] = 0
    visible[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.diff(visible)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ROLL[0])


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles, sorted; a text with fewer words than a shingle is one shingle, one without words has none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(words)
    if n == 0:
        return words
    if n < WIDTH:
        return mixed(np.sum(words * _ROLL[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        total += words[k : n - WIDTH + 1 + k] * _ROLL[k]
    return np.unique(mixed(total))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
