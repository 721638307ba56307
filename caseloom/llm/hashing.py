"""Numpy hashing of byte ranges: words, shingles, runs and windows.

No hash here is a polynomial: bytes are read eight at a time and each block goes
through ``mix`` with its place before blocks are added, so that strings built
from few pieces in many orders don't meet, as they do modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes whose words are found in one piece.
MOST_AT_ONCE = 1 << 19
_PLACE = 0x9E3779B97F4A7C15
_LENGTH = U(0xA0761D6478BD642F)
_SEEDS = [U((x * 0xE7037ED1A0B428DB) & (2**64 - 1)) for x in range(4)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for two hashes in their order."""
    x = a * U(0xD1342543DE82EF95)
    x += b
    x ^= x >> U(32)
    x *= U(0xAF251AF3B0F025B5)
    x ^= x >> U(29)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """At each place, that byte and the seven after it as one number; past the end come zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))


def blocks_of(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of eight bytes of each range: where each begins, its place in the range, the mask of its bytes, and where each range's blocks begin."""
    n = e - s
    count = np.maximum((n + 7) >> 3, 1)
    begin = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(begin, count)
    mask = np.full(len(place), ~U(0))
    last = begin + count - 1
    left = (8 * count - n).astype(np.uint64)
    mask[last] = np.where(left < U(8), ~U(0) >> (U(8) * np.minimum(left, U(7))), U(0))
    return np.repeat(s, count) + 8 * place, place, mask, begin


def ranges(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of each byte range data[s:e]."""
    if not len(s):
        return np.zeros(0, np.uint64)
    at, place, mask, begin = blocks_of(s, e)
    # take copies its whole source, which pays for short ones alone
    x = np.take(eights(data), at) if len(data) <= MOST_AT_ONCE else eights(data)[at]
    x &= mask
    return sums(x, place, begin, e - s, seed)


def sums(x: np.ndarray, place: np.ndarray, begin: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of each run of numbers: x[begin[i]] and so on, each with its place in the run."""
    x = mix(x ^ _SEEDS[seed])
    x += (place.astype(np.uint64) + U(1)) * U(_PLACE)
    return mix(np.add.reduceat(mix(x), begin) + length.astype(np.uint64) * _LENGTH)


def windows(x: np.ndarray, k: int, have: int = 1) -> np.ndarray:
    """Of each run of k elements, where x[i] is the hash of ``have`` of them from i on; by doubling, the last step overlaps."""
    while have * 2 <= k:
        x = joined(x[:-have], x[have:])
        have *= 2
    if rest := k - have:
        x = joined(x[: max(0, len(x) - rest)], x[rest:])
    return x


def fixed(data: np.ndarray, k: int) -> np.ndarray:
    """Of each range of k bytes; k is 8 or more."""
    return windows(mix(eights(data)[: max(0, len(data) - 7)]), k, 8)


def window_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` elements."""
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    if rest := width - have:
        a = np.minimum(a[: len(a) - rest], a[rest:])
    return a


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated rows: hash, start, end, and where each row's words begin."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    if len(data) > MOST_AT_ONCE and len(off) > 2:  # rows in pieces, so that the sums stay small
        parts, cut = [], 0
        while cut < len(off) - 1:
            end = min(max(cut + 1, int(np.searchsorted(off, off[cut] + MOST_AT_ONCE, "right")) - 1), len(off) - 1)
            h, s, e, at = words(data[off[cut] : off[end]], off[cut : end + 1] - off[cut], lower)
            parts.append((h, s + off[cut], e + off[cut], np.diff(at)))
            cut = end
        h, s, e, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return h, s, e, np.concatenate(([0], np.cumsum(n)))
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a row's end parts words
    edge[off] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1 : len(data)]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1 : len(data)]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    h = ranges(_LOWER[data] if lower else data, s, e)
    return h, s, e, np.searchsorted(s, off)


_STEP = [U(pow(0xC2B2AE3D27D4EB4F, i, 1 << 64)) for i in range(64)]


def shingles(h: np.ndarray, at: np.ndarray, k: int = 5):
    """Hashes of runs of k words inside each row: hash, row, and where each row's runs begin.

    A row of 1 to k - 1 words has one run, all its words.
    """
    n_rows = len(at) - 1
    count = np.diff(at)
    if len(h) >= k:
        n = len(h) - k + 1
        run = h[:n] * _STEP[0]
        for i in range(1, k):
            run += h[i : n + i] * _STEP[i]
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    made = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    made[short] = 1
    begin = np.zeros(n_rows + 1, np.int64)
    np.cumsum(made, out=begin[1:])
    row = np.repeat(np.arange(n_rows), made)
    src = at[row] + np.arange(begin[-1]) - begin[row]
    out = np.zeros(begin[-1], np.uint64)
    if len(run):
        np.take(run, np.minimum(src, len(run) - 1), out=out)
    for r in short:
        v = U(int(count[r]))
        with np.errstate(over="ignore"):
            for i, x in enumerate(h[at[r] : at[r + 1]]):
                v = v + x * _STEP[i + 8]
        out[begin[r]] = mix(np.array([v], np.uint64))[0]
    return out, row, begin
