"""Words and their hashes, for whole Arrow batches at once.

A word is a maximal run of bytes other than the space and the controls 0x09 to
0x0D (``[^\\x20\\x09-\\x0D]+`` in a UTF-8 text).  A word's hash is a polynomial
over fixed 64-bit values of its bytes, read off prefix sums modulo 2**64, so a
batch costs a few vector operations and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 3)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text worked on at a time; a longer text is worked on alone.
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1B54A32D192ED03))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, kept for the next batch."""
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a column of texts; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


class Words:
    """The words of some texts: ``start`` and ``end`` in ``data``, ``doc`` the
    index of the text, ``first[i]:first[i + 1]`` the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets - offsets[0]
        n = len(self.offsets) - 1
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], word))
        after = np.concatenate((word, [False]))
        self.start = np.flatnonzero(after[:-1] & (~before[:-1] | edge[:-1]))
        self.end = np.flatnonzero(before[1:] & (~after[1:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        power, inverse = _power(len(self.data))
        table = _LOWER if lower else _BYTES
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])


def pieces(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for consecutive rows of about ``PIECE`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    lo, n = 0, len(sizes)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
        hi = min(hi, n)
        data, offsets = buffers(column.slice(lo, hi - lo))  # a copy of these rows at most, not of the column
        yield lo, hi, Words(data[offsets[0] : offsets[-1]], offsets)
        lo = hi


def grams(hashes: np.ndarray, n: int, step: np.ndarray | None = None) -> np.ndarray:
    """Hash of every n consecutive values (or those at the offsets ``step``)."""
    at = list(range(n) if step is None else step)
    m = max(0, len(hashes) - at[-1])
    out = np.full(m, U(len(at) * 0x9FB21C651E98DF25 % 2**64), np.uint64)
    for j, k in enumerate(at):
        out = (out ^ hashes[k : k + m]) * U((0xC2B2AE3D27D4EB4F + 2 * j) % 2**64)
        out = out ^ (out >> U(29))
    return mix(out)


def shingles(words: Words, hashes: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles as 64-bit hashes; a text
    of fewer words has its whole sequence as one shingle, one without words none."""
    every = grams(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(grams(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
