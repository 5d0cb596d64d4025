"""FM-index over a sequence of symbols: wavelet-matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the last symbol must be smaller than all others."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, dtype=np.int64)
        ordered = key[order]
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if rank.max() == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Bit levels of a sequence, most significant first, each with the number of ones before a position."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``position``, for arrays of both."""
        start = np.zeros_like(position)
        for depth in range(self.levels):
            bit = (symbol >> (self.levels - 1 - depth)) & 1
            ones, zeros = self.ones[depth], self.zeros[depth]
            a, b = ones[start], ones[position]
            start = np.where(bit, zeros + a, start - a)
            position = np.where(bit, zeros + b, position - b)
        return position - start

    def access(self, position: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(position)
        for depth in range(self.levels):
            ones, zeros = self.ones[depth], self.zeros[depth]
            before = ones[position]
            bit = ones[position + 1] - before
            symbol = (symbol << 1) | bit
            position = np.where(bit, zeros + before, position - before)
        return symbol


class FMIndex:
    """Index of one shard. ``symbols`` must end with its only zero."""

    def __init__(self, symbols: np.ndarray):
        symbols = symbols.astype(np.int64)
        self.n = len(symbols)
        order = suffix_array(symbols)
        self.tree = WaveletMatrix(symbols[order - 1])
        counts = np.bincount(symbols)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        sampled = order % SAMPLE_EVERY == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of many patterns of one length, read backwards together."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        known = len(self.first) - 1
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            there = symbol < known
            high[live[~there]] = low[live[~there]]
            live, symbol = live[there], symbol[there]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        found = np.zeros(len(patterns), dtype=bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step to the symbol before until a sampled row is met."""
        out = np.empty(len(rows), dtype=np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        steps = 0
        while len(open_):
            hit = self.sampled[at]
            out[open_[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            if len(open_):
                symbol = self.tree.access(at)
                at = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
