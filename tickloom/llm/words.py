"""Words of a whole column of texts at once, as numpy arrays; used inside tasks.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Names of words and of word sequences are 64-bit
polynomial hashes over the ring of integers modulo 2^64, finished by an avalanche step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _BASE_WIDE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
SHORT_WINDOW = 4
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit (the finisher of the public SplitMix64 generator)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
        return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 ... base^(n-1) and their inverses modulo 2^64; kept for the largest n asked for so far."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(base, -1, 2**64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


def range_names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """One name per range [start, end) of `values`; equal ranges have equal names."""
    up, down = _powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.multiply(values, up[: len(values)], out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(_BASE_WIDE))


@dataclass
class Words:
    """`first[i]` to `first[i + 1]` are the words of text i; `start` and `end` are byte positions in `data`."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def names(self) -> np.ndarray:
        return range_names(_BYTE_VALUES[self.data], self.start, self.end)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def bytes_of(self, i: int) -> list[bytes]:
        return self.data[self.text[i] : self.text[i + 1]].tobytes().split()


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Null texts have no words; `lower` folds A-Z only."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = _LOWER[data]
    inside = ~_BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, bounds), bounds)


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where `width` consecutive words of one text start, and the text of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    skipped = np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][owner] + np.arange(len(owner)) - skipped, owner


def window_names(names: np.ndarray, starts: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Name of the `width` words from each start; `second` gives an independent name of the same words."""
    if width <= SHORT_WINDOW and not second:  # the same names, without sums over all words
        with np.errstate(over="ignore"):
            total = names[starts]
            for i in range(1, width):
                total += names[starts + i] * _U(pow(_BASE, i, 2**64))
            return mixed(total + _U(width * _BASE_WIDE % 2**64))
    return range_names(mixed(names ^ _U(0x5BD1E995)) if second else names, starts, starts + width, _BASE_WIDE if second else _BASE)


def distinct_by_owner(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key), sorted, and how often each occurs."""
    if not len(keys):
        return owner, keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    short = owner.astype(np.uint16) if owner.max() < 65536 else owner  # sorted by radix
    order = order[np.argsort(short[order], kind="stable")]
    o, k = owner[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return o[at], k[at], np.diff(np.append(at, len(k)))
