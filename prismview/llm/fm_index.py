"""An FM-index over a shard of symbols: suffix array, wavelet matrix, sampled positions.

Symbol 0 separates runs; every separator counts as a distinct letter that is
smaller than all words, so no match and no walk crosses one.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; it stops at the length of the longest repeat."""
    n = len(symbols)
    gaps = symbols == 0
    rank = symbols.astype(np.int64) + int(gaps.sum())
    rank[gaps] = np.arange(int(gaps.sum()))  # separators differ, so a comparison ends at the first one
    step = 1
    while True:
        follow = np.full(n, -1, np.int64)
        if step < n:
            follow[:-step] = rank[step:]
        key = rank * (int(rank.max()) + 2) + follow + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if rank.max() == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """rank(symbol, position) over a sequence, for arrays of queries at once."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32)
            self.levels.append((bit, before, len(sequence) - int(before[-1])))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(position), position
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            start = np.where(one, zeros + before[start], start - before[start])
            end = np.where(one, zeros + before[end], end - before[end])
        return end - start


class FMIndex:
    def __init__(self, symbols: np.ndarray, largest: int):
        """``symbols``: ends with 0; values up to ``largest``."""
        n = len(symbols)
        order = suffix_order(symbols)
        self.last = symbols[order - 1].astype(np.int64)  # order 0 wraps round to the closing separator
        counts = np.bincount(symbols, minlength=largest + 2)
        self.smaller = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.tree = WaveletMatrix(self.last, largest)
        sampled = np.arange(n) % SAMPLE_EVERY == 0
        sampled[0] = True
        sampled[1:] |= symbols[:-1] == 0  # the first word of a run: a walk never has to leave it
        self.sampled = sampled[order]
        self.place = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``patterns``, all searched backwards together."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.last), np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column].astype(np.int64)
            base = self.smaller[symbol]
            low[live] = base + self.tree.rank(symbol, low[live])
            high[live] = base + self.tree.rank(symbol, high[live])
            found = high[live] > low[live]
            low[live[~found]] = high[live[~found]] = 0
            live = live[found]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back to the nearest sampled suffix."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol = self.last[rows[walking]]
            rows[walking] = self.smaller[symbol] + self.tree.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.place[rows] + steps
