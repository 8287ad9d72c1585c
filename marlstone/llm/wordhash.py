"""Words of many texts as numpy arrays of 64-bit hashes, found at the level of UTF-8 bytes.

Separators of the word classes below are ASCII characters and every byte of a longer character counts as
a letter, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text that are hashed at a time, unless a single text is longer.
SEGMENT = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mask(separators) -> np.ndarray:
    m = np.ones(256, dtype=bool)
    m[list(separators)] = False
    return m


#: Words are what lies between white space.
NON_SPACE = _mask([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, lower-case letters and anything beyond ASCII.
ALNUM = _mask([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * _MIX_1
    x = (x ^ (x >> U(27))) * _MIX_2
    return x ^ (x >> U(31))


_powers = np.ones(1, dtype=U)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        more = np.full(size, _BASE, dtype=U)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are sorted and not empty."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    lens = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    place = inside - np.repeat(starts, lens)
    terms = (b[inside].astype(U) + U(1)) * _powers_to(int(lens.max()))[place]
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lens)[:-1])))
    return mix(sums + lens.astype(U) * _MIX_1)


@dataclass
class Words:
    """Hashes of the words of some texts: those of text i are hashes[ptr[i]:ptr[i + 1]]."""

    hashes: np.ndarray
    ptr: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.ptr[i] : self.ptr[i + 1]]

    def texts(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def words_of(texts: Sequence[str | None], letters: np.ndarray, lower: bool = True) -> Words:
    """The words of each text; none for null."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    counts, hashes = np.zeros(len(raw), dtype=np.int64), []
    k = 0
    while k < len(raw):
        first, size = k, 0
        while k < len(raw) and (k == first or size + len(raw[k]) < SEGMENT):
            size += len(raw[k]) + 1
            k += 1
        b = np.frombuffer(b"\n".join(raw[first:k]) + b"\n", dtype=np.uint8)
        at = np.cumsum([0] + [len(x) + 1 for x in raw[first:k]])
        for lo, hi in _pieces(b, letters):
            piece = LOWER[b[lo:hi]] if lower else b[lo:hi]
            word = letters[piece]
            edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
            starts, ends = edges[::2], edges[1::2]
            hashes.append(hash_spans(piece, starts, ends))
            counts[first:k] += np.diff(np.searchsorted(starts + lo, at))
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, dtype=U), np.concatenate(([0], np.cumsum(counts))))


def _pieces(b: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a long text behind separators, so that arrays stay small."""
    lo = 0
    while lo < len(b):
        hi = min(len(b), lo + SEGMENT)
        if hi < len(b):
            back = np.flatnonzero(~_is_word(b[lo:hi], letters))
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(~_is_word(b[hi:], letters))
                hi = hi + int(ahead[0]) + 1 if len(ahead) else len(b)
        yield lo, hi
        lo = hi


def _is_word(b: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return letters[LOWER[b]]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words inside one text, and the index of each run's first word."""
    h = words.hashes
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    s = h[:n].copy()
    for j in range(1, k):
        s = mix(s * _BASE + h[j : n + j])
    ends = np.repeat(words.ptr[1:], np.diff(words.ptr))[:n]
    at = np.flatnonzero(np.arange(n) + k <= ends)
    return s[at], at
