"""Hashed word and character n-grams of whole texts, for a slice of an Arrow batch at a time, in numpy.

A slice holds a few texts laid end to end as UTF-8, at most SLICE bytes of them or one longer text, so
memory follows the longest text and not the batch. Every feature is a bucket number; a feature belongs
to the text whose bytes it covers and never crosses into the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word proper: ASCII letters and digits, and all of a longer UTF-8 character.
_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse, modulo 2**64."""
    global _power, _inverse
    if len(_power) < n:
        base = np.full(max(n, SLICE), _ODD, np.uint64)
        base[0] = 1
        back = np.full(len(base), _INVERSE, np.uint64)
        back[0] = 1
        _power, _inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _power[:n], _inverse[:n]


@dataclass
class Slice:
    """first: row of the batch; octets: the texts end to end; bounds: where each begins, and the end."""

    first: int
    octets: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, lower: bool = False, most: int = SLICE) -> Iterator[Slice]:
    """Null texts count as empty."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    octets = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield Slice(i, octets[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


def char_grams(s: Slice, n: int, bits: int) -> np.ndarray:
    """The bucket of the n bytes from each place on; of text k those from bounds[k] to bounds[k + 1] - n are its own."""
    if len(s.octets) < n:
        return np.zeros(0, np.int64)
    size = len(s.octets) - n + 1
    h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ s.octets[k : k + size]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class Words:
    hashes: np.ndarray  # 64 bits for each word
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text k: bounds[k] to bounds[k + 1]
    sums: np.ndarray  # of the octets times powers of the base, up to each place

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash of its first `size` bytes) for the words that are longer than that."""
        at = np.flatnonzero(self.ends - self.starts > size)
        begin = self.starts[at]
        return at, (self.sums[begin + size] - self.sums[begin]) * _powers(len(self.sums))[1][begin]


def words(s: Slice, proper: bool = False) -> Words:
    """What stands between white space, or with proper: runs of letters and digits."""
    inside = _WORD[s.octets] if proper else ~_SPACE[s.octets]
    edge = np.zeros(len(s.octets) + 1, bool)
    edge[s.bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(len(s.octets) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((s.octets.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return Words((sums[ends] - sums[starts]) * down[starts], starts, ends, np.searchsorted(starts, s.bounds), sums)


def bucket(h: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x51ED270B27D4EB4F & 0xFFFFFFFFFFFFFFFF)) * _MIX
    h ^= h >> np.uint64(32)
    return ((h * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """A hash for each two words that follow each other; a word said twice gives one and the same hash."""
    out = h[:-1] * _MIX + (h[1:] ^ (h[1:] >> np.uint64(29))) * _ODD
    return np.where(h[:-1] == h[1:], np.uint64(0x2545F4914F6CDD1D), out)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """values[starts[k]:ends[k]].sum(0) for each k, 0 where there are none; the same for equal texts in any slice."""
    out = np.zeros((len(starts), *values.shape[1:]))
    some = np.flatnonzero(ends > starts)
    if len(some):
        padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        out[some] = np.add.reduceat(padded, np.stack([starts[some], ends[some]], 1).ravel(), axis=0, dtype=np.float64)[::2]
    return out
