"""Words, word hashes and shingle hashes of whole Arrow string columns, by numpy over the raw bytes.

A text is cut into words where a byte table says so; the hash of a word is that of its bytes as a polynomial modulo
2^64, read off prefix sums, so no Python object is made for a word. All functions work on a slice of a column at a
time (``slices``), so memory is bounded by the slice or by the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import by_value, process_store

by_value(__name__)

#: Fixed odd multipliers of the polynomial hashes, and the constants of the 64-bit finaliser by Steele et al.
BASE_BYTE, BASE_WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    kept = process_store().setdefault("powers", {})
    if base not in kept or len(kept[base][0]) < n:
        size = ((n >> 16) + 1) << 16
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        kept[base] = tuple(both)
    return kept[base][0][:n], kept[base][1][:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hashes of values[start:end]."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array, size: int = 1 << 19):
    """(first row, last row, bytes, offsets) of runs of rows of about ``size`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """The words of a slice: byte ``starts`` and ``ends``, and ``first``: the number of the first word of each text, and their total."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.offsets = (LOWER[data] if lower else data), offsets
        word = ~SPACE[self.data]
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before[inner] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return spans(self.data, self.starts, self.ends, BASE_BYTE)

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and ``first`` for them. Texts of fewer words have none."""
    n = np.diff(first)
    each = np.maximum(n - k + 1, 0)
    begins = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
    return spans(hashes, begins, begins + k, BASE_WORD), np.concatenate([[0], np.cumsum(each)])


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, sorted by text and hash; fewer words: the whole as one; none: none."""
    n = np.diff(first)
    each = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    lens = np.minimum(n, k)
    total = np.concatenate([[0], np.cumsum(each)])
    begins = np.repeat(first[:-1] - total[:-1], each) + np.arange(total[-1])
    h = spans(hashes, begins, begins + np.repeat(lens, each), BASE_WORD)
    text = np.repeat(np.arange(len(n)), each)
    for a, b in zip(total[:-1], total[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(n) + 1))
