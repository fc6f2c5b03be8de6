"""A full-text index over small-integer sequences: suffix array, BWT, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Sorted suffix starts by prefix doubling; ``seq`` must end with its only 0."""
    n = seq.size
    rank = seq.astype(np.int64)
    width = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + int(seq.max()) + 3) + follow
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class WaveletMatrix:
    """Rank of any symbol in any prefix, in as many steps as a symbol has bits."""

    def __init__(self, seq: np.ndarray) -> None:
        self.bits = max(1, int(seq.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(now.size - self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(end), end
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    """Backward search and location over one sequence of symbols from 1 up."""

    def __init__(self, seq: np.ndarray, sample: int = 8) -> None:
        seq = np.concatenate([seq.astype(np.int64), [0]])
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq))])
        self.tree = WaveletMatrix(self.bwt)
        self.sampled = order % sample == 0
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of the rows of ``phrases``, all of one length."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.bwt.size, dtype=np.int64)
        live = np.flatnonzero(phrases.max(axis=1, initial=0) < self.first.size - 1)
        dead = np.ones(len(phrases), dtype=bool)
        dead[live] = False
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
            dead[live] = low[live] >= high[live]
            live = live[~dead[live]]
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(rows.size, dtype=np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while todo.size:
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.tree.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.positions[self.before[rows]] + steps
