"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial of a random table over its bytes, so words of a whole Arrow
buffer come from one running sum; A-Z count as a-z.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE[65:91] = _TABLE[97:123]
_powers: dict[int, np.ndarray] = {}

#: Bytes that part words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:0x80] = True
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    NOT_WORD[_lo:_hi] = False


def _power(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        _powers[base] = np.cumprod(step, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of each (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """hash: of each word; first: index of each text's first word (one more at the end); start, end: byte places."""

    def __init__(self, texts: pa.Array, parts: np.ndarray = SPACES):
        data, offsets = buffers(texts)
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~parts[data]
        cuts = np.zeros(n + 1, bool)
        cuts[offsets] = True
        before, here = inside[:-1], inside[1:]
        self.start = np.flatnonzero(here & (~before | cuts)).astype(np.int64)
        self.end = np.flatnonzero(before & (~here | cuts)).astype(np.int64)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power(_BASE, n), dtype=np.uint64, out=running[1:])
        self.hash = mix((running[self.end] - running[self.start]) * _power(_INV, n + 1)[self.start])
        self.first = np.searchsorted(self.start, offsets)
        self.offsets, self.data = offsets, data


_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def combine(hashes: np.ndarray, places: tuple[int, ...], n: int) -> np.ndarray:
    """For the n starts i: one hash of the words i + place."""
    total = np.zeros(n, np.uint64)
    for k, place in enumerate(places):
        total += hashes[place : place + n] * _MULTIPLIERS[k]
    return mix(total)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words the whole sequence is the one shingle."""
    h, first = words.hash, words.first
    grams = combine(h, tuple(range(k)), max(0, len(h) - k + 1))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        n = hi - lo
        if n >= k:
            s = np.sort(grams[lo : hi - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif n:
            out.append(combine(np.concatenate((h[lo:hi], np.full(1, n, np.uint64))), tuple(range(n + 1)), 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def segment_hashes(codes: np.ndarray, spread: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each segment of codes, the same wherever it stands; spread: an odd 64-bit number for each code."""
    running = np.zeros(len(codes) + 1, np.uint64)
    values = spread[codes]
    values *= _power(_BASE, len(codes))
    np.cumsum(values, dtype=np.uint64, out=running[1:])
    h = running[start + size]
    h -= running[start]
    h *= _power(_INV, len(codes) + 1)[start]
    h ^= h >> U(31)
    return h


def distinct(codes: np.ndarray, spread: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one segment of each kind, the kind of every segment). Hashes find the kinds; codes are then
    compared, and segments that differ from their hash's first one are kinds of their own."""
    h = segment_hashes(codes, spread, start, size)
    order = np.argsort(h)
    ranked = h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    one = order[fresh]
    first = one[kind]
    ends = np.cumsum(size)
    shift = np.repeat((start[first] - start).astype(np.int32), size)
    here = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    here += np.repeat((start - ends + size).astype(np.int32), size)
    # Behind a shorter first segment other codes would be read; sizes tell those apart.
    other = size != size[first]
    differ = codes[here] != codes[np.minimum(here + shift, len(codes) - 1)]
    if differ.any():
        other[np.searchsorted(ends, np.flatnonzero(differ), "right")] = True
    if other.any():
        bad = np.flatnonzero(other)
        kind[bad] = len(one) + np.arange(len(bad))
        one = np.concatenate((one, bad))
    return one, kind


class Taken:
    """Stretches of a text, for asking many times whether a span touches one of them."""

    def __init__(self, spans):
        # Base spans of several kinds may overlap; what they cover together doesn't.
        self.start, self.end = [], []
        for a, b in sorted(spans):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.start, end)
        return k == 0 or self.end[k - 1] <= start
