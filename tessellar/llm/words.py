"""Words of whole Arrow text columns, found and hashed with numpy on the UTF-8 bytes (no string per word)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18


def space_words() -> np.ndarray:
    """Marks the bytes of words that white space (space, 9 to 13) parts."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def item_words() -> np.ndarray:
    """Marks the bytes of words of digits, letters and everything beyond ASCII."""
    t = np.ones(256, bool)
    t[0:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = False
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """hashes, byte starts and ends of all words; ``first[d]`` to ``first[d + 1]`` are those of text d."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Splits and hashes the A-Z lower-cased words of the texts that the offsets part."""
    data = LOWER[data]
    inside = is_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = False, False
    begins, stops = inside.copy(), np.zeros(len(data) + 1, bool)
    if len(data):
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[1:] &= ~inside[:-1]
        begins[cuts] = inside[cuts]
        stops[1:-1] = inside[:-1] & ~inside[1:]
        stops[-1] = inside[-1]
        inner = cuts[cuts > 0]
        stops[inner] |= inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return Words(_hash(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from prefix sums over pieces that end between words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _PIECE, "right")))
        n = int(ends[j - 1]) - at
        size = max(_PIECE, 1 << (n - 1).bit_length())
        power, inverse = _powers(size) if size == _PIECE else _powers.__wrapped__(size)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[at : at + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


_ODD = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``size`` words, and the n + 1 offsets of each text's; fewer words make one run."""
    n = words.counts
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    text = np.repeat(np.arange(len(n)), per)
    at = words.first[text] + (np.arange(total) - first[text])
    short = (n < size)[text]
    h = np.zeros(total, np.uint64)
    for k in range(size):
        odd = _ODD[k % 5] + np.uint64(2 * (k // 5))
        if short.any():
            there = ~short | (k < n[text])
            h[there] += words.hashes[at[there] + k] * odd
        else:
            h += words.hashes[at + k] * odd
    if short.any():
        h[short] += n[text[short]].astype(np.uint64)
    return mix(h), first
