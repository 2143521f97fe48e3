"""Vectorised word handling on UTF-8 bytes, shared by the operators of this subpackage.

Texts of a chunk are joined by a space (never a word byte), so one pass of numpy over the joined
bytes finds all words. A word's 64-bit fingerprint is a polynomial over random byte values, taken
from prefix sums and mixed; equal words always have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of runs without ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of digits, a-z (after lower-casing) and all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 19), base, np.uint64)
        out[0] = 1
        _powers[name] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Different values, ascending; by a sort, which for 64-bit numbers is many times faster than np.unique's table."""
    s = np.sort(values)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among `known`, which ascend."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Words:
    """Words of several texts: start and end in `data`, fingerprint, and `first[i]:first[i+1]` for text i."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        self.data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.zeros(0, np.uint8)
        inside = np.concatenate(([False], word_bytes[self.data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[self.data] * _power("up", _BASE, n), out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * _power("down", _INVERSE, n + 1)[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64))
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.text_start = at
        self.first = np.searchsorted(self.start, at)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of `size` words, and where each text's begin (length texts + 1).

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        whole = mix(whole * _U(0xD6E8FEB86659FD93) + h[k : k + len(whole)])
    many = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(int(begin[-1]), np.uint64)
    long = count >= size
    owner = np.repeat(np.arange(len(count)), np.where(long, many, 0))
    if len(owner):
        inner = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(np.where(long, many, 0))))[:-1], np.where(long, many, 0))
        out[begin[owner] + inner] = whole[first[owner] + inner]
    for i in np.flatnonzero((count > 0) & ~long):
        value = np.full(1, int(count[i]), np.uint64)
        for k in range(int(count[i])):
            value = mix(value * _U(0xD6E8FEB86659FD93) + h[first[i] + k : first[i] + k + 1] + _U(1))
        out[begin[i]] = value[0]
    return out, begin


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = 1 << 18) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Arrow batches as chunks of about `size` bytes of text: the other columns, and texts as bytes (null: empty)."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
        others = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != text}
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t) + 1
            if held >= size or i + 1 == len(texts):
                yield {n: v[start : i + 1] for n, v in others.items()}, texts[start : i + 1]
                start, held = i + 1, 0
