"""Vectorised word hashes of Arrow text columns, shared by the operators of this subpackage.

A word is a maximal run of bytes other than space and 0x09-0x0D, A-Z lower-cased; a shingle is a run of ``width``
words of one document. Both are known by 64-bit hashes, computed for a block of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
WIDTH = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
BYTE_LOWER = BYTE[LOWER]


@lru_cache(maxsize=4)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for ``2**bits`` positions."""
    out = []
    for base in (_BASE, pow(_BASE, -1, _WORD)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offset of each row, with the end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a block of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word (with the end)."""
    blank = IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], blank[:-1]]) | edge[:-1] if len(raw) else edge[:0]
    after = np.concatenate([blank[1:], [True]]) | edge[1:] if len(raw) else edge[:0]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Spans:
    """Hashes of byte spans of one block; spans that are equal by ``table`` (default: A-Z lower-cased) have equal hashes."""

    def __init__(self, raw: np.ndarray, table: np.ndarray = BYTE_LOWER) -> None:
        up, self.down = powers(max(16, int(len(raw)).bit_length()))
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * up[: len(raw)], out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    return Spans(raw, table).hashes(starts, ends)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows, in order, and the index of each row's first word (with the end)."""
    starts, ends, first = word_bounds(raw, offsets)
    return span_hashes(raw, starts, ends), first


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of each run of ``width`` words; entry i starts at word i (rows are not told apart)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + words[i: i + n]
    return mix(out)


def shingles_by_row(words: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each row in order, with the offset of each row; a shorter row is one shingle, an empty one none."""
    counts = np.diff(first)
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(offsets[-1], np.uint64)
    every = shingle_hashes(words, width)
    full = np.flatnonzero(counts >= width)
    if len(full):
        n = per_row[full]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(offsets[full], n) + within] = every[np.repeat(first[full], n) + within]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[first[r]: first[r + 1]]
        out[offsets[r]] = shingle_hashes(w, len(w))[0]
    return out, offsets
