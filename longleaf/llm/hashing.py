"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that separate words: ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


def words(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes without ASCII white space), and the text it is in."""
    raw = [v.encode("utf-8", "surrogatepass") for v in values]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~_SPACE[data]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = stop - start
    longest = int(size.max())
    powers = _powers(1 << max(8, longest.bit_length()))
    at = np.flatnonzero(letter)
    pos = at - np.repeat(start, size)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * powers[pos]
    total = np.add.reduceat(value, np.concatenate([[0], np.cumsum(size)[:-1]]))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return mix(total), np.searchsorted(ends, start, side="right")


def shingles(values: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words, and its text; a text of fewer words (at least one) has one shingle of them all."""
    word, text = words(values)
    counts = np.bincount(text, minlength=len(values)) if len(text) else np.zeros(len(values), np.int64)
    first = np.cumsum(counts) - counts
    made = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    owner = np.repeat(np.arange(len(values)), made)
    at = np.repeat(first, made) + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    length = np.minimum(counts[owner], width)
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        has = length > j
        step = np.where(has, word[np.minimum(at + j, max(len(word) - 1, 0))], np.uint64(0)) if len(word) else out
        out = (out ^ step) * _ODD + np.uint64(j)
    return mix(out), owner


def shingle_sets(values: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their text and how often they occur in it."""
    h, owner = shingles(values, width)
    if not len(h):
        return h, owner, np.zeros(0, np.int64)
    _, at, n = np.unique(h ^ mix(owner.astype(np.uint64) + _ODD), return_index=True, return_counts=True)
    order = np.argsort(at)
    return h[at][order], owner[at][order], n[order]
