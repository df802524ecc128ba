"""Words and word n-grams of Arrow string columns as NumPy arrays.

A word is a run of bytes other than ASCII white space, which equals a run of characters other than
U+0009-U+000D and U+0020 because UTF-8 never uses those bytes inside a character. Every hash is a polynomial
over 64-bit words modulo 2**64 with an odd base, taken from prefix sums, then mixed. Two different n-grams get
the same hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _tables[int(base)] = np.cumprod(up), np.cumprod(down)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (or of one row), so that work arrays stay small."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end
        row = end


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array without nulls: a null text counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


class Words:
    """Words of rows [row, end) of a string array: hash of each, and first[i]:first[i + 1] for row i."""

    def __init__(self, texts: pa.Array, row: int, end: int, lower: bool = False) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)[row : end + 1].astype(np.int64)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        if lower:
            self.data = _LOWER[self.data]
        solid = ~_SPACE[self.data]
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(solid))]
        opens[inner] = solid[inner]
        closes[inner - 1] = solid[inner - 1]
        self.start, self.stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = _powers(BYTE_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        self.hash = mix((sums[self.stop] - sums[self.start]) * down[self.start])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position; positions whose n-gram leaves the row are of no meaning."""
        return grams(self.hash, n)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def span_hash(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to its stop."""
    up, down = _powers(WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
