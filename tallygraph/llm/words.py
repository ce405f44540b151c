"""Vectorised word kernels over Arrow text batches.

A batch's texts are one byte buffer; words, their owners and their 64-bit
hashes come from numpy passes over that buffer, so the cost is a few
nanoseconds a byte whatever the text's shape.  Null text reads as empty text.
Word classes work on bytes because every non-ASCII byte of UTF-8 belongs to a
word in both classes used here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
#: Odd bases of polynomial hashes; the second is for a hash independent of the first.
_P, OTHER = 0x5851F42D4C957F2D, 0xD1342543DE82EF95

# Lower-casing of A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: True for bytes of words split at the six ASCII white-space characters.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: True for bytes of words of digits, lower-case letters and non-ASCII characters.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Words of a batch: ``start``/``end`` byte positions, ``first[d]`` the index
    of document d's first word (n + 1 entries), ``hash`` 64-bit word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool):
        if fold:
            data = FOLD[data]
        self.data, self.offsets = data, offsets
        inside = kind[data]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        cut = offsets[:-1]
        cut = cut[cut < offsets[1:]]
        edge[cut] = inside[cut]
        self.start = np.flatnonzero(edge)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cut[1:] - 1] = inside[cut[1:] - 1]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, block: int = 1 << 22, base: int = _P) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its bytes, then mixed."""
        out = np.empty(len(self.start), np.uint64)
        at, inverse = 0, pow(base, -1, 1 << 64)
        while at < len(self.start):  # blocks bound the 8-byte temporaries
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + block, "right")))
            part = self.data[lo : self.end[to - 1]]
            powers = _powers(len(part), base)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _powers(len(part), inverse)[s] + (e - s).astype(np.uint64) * _M1
            at = to
        return mix(out)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive word hashes from each position (len - n + 1 of
    them, across document borders too: callers drop those)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= np.uint64(_P)
        out += hashes[i : i + m]
    return mix(out)


def double(hashes: np.ndarray, length: int, gap: int) -> np.ndarray:
    """Hash of two windows of ``length`` words that start ``gap`` words apart."""
    m = max(0, len(hashes) - gap)
    return mix(hashes[:m] * np.uint64(_P) + hashes[gap : gap + m] + np.uint64(length))
