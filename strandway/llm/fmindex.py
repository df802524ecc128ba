"""A compressed FM-index over a sequence of small integers: wavelet matrix of packed bits, backward search.

Suffixes are sorted by their first ``depth`` symbols, which is all that patterns of up to that length need; longer ones
are refused, as their intervals would hold other rows. Searches run for many patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH, START = 32, 8


class Bits:
    """Packed bits with the count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros((n >> 6) + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        low = self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low).astype(np.int64)


class FMIndex:
    """Index of ``text``, whose symbols are 0 (separators) to ``symbols`` - 1, for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int = DEPTH) -> None:
        self.n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < max(depth, START):
            ahead = np.zeros(self.n, np.int64)
            ahead[:-step or None] = rank[step:] + 1 if step < self.n else 0
            rank = np.unique(rank * (self.n + symbols + 1) + ahead, return_inverse=True)[1]
            step *= 2
            if step == START:
                short = rank
        self.depth = step
        self.suffixes = np.argsort(rank, kind="stable")
        order = np.argsort(short, kind="stable")  # the same groups of START symbols, in the same places
        opens = np.concatenate([[0], np.flatnonzero(np.diff(short[order])) + 1, [self.n]])
        self.short_lo, self.short_hi = opens[short], opens[short + 1]
        last = text[self.suffixes - 1]
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (last >> bit & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(ones) - np.count_nonzero(ones)))
            last = np.concatenate([last[~ones], last[ones]])
        every = np.arange(symbols)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        self.shift = smaller - self._descend(every, np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for i, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(at)
            at = np.where(symbol >> (top - i) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns."""
        shift = self.shift[symbol]
        return self._descend(symbol, lo) + shift, self._descend(symbol, hi) + shift

    def repeated(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, lo, hi) of those windows of the text that occur more than once: backward search from a table of the
        last START symbols' intervals, given up where only the window itself is left."""
        if not START <= length <= self.depth:
            raise ValueError(f"windows of {length} symbols in an index for {START} to {self.depth}")
        at = starts + length - START
        lo, hi = self.short_lo[at], self.short_hi[at]
        for _ in range(length - START):
            go = hi - lo > 1
            at, lo, hi, starts = at[go] - 1, lo[go], hi[go], starts[go]
            if not len(at):
                break
            lo, hi = self.extend(text[at], lo, hi)
        go = hi - lo > 1
        return starts[go], lo[go], hi[go]
