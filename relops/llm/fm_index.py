"""FM-index over a sequence of small integers: wavelet matrix, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

from relops.llm.suffix_arrays import refined_order

SAMPLE = 8


class FMIndex:
    """Index of ``text``, whose symbols are from 1 up to ``size`` - 1; symbol 0 ends it."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        text = np.append(text, 0).astype(np.int64)
        self.length = len(text)
        order = refined_order(text, 1, self.length)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.shifts = list(range(max(int(size - 1).bit_length(), 1)))[::-1]
        self.ones, self.zeros = [], []
        last = text[order - 1]
        for shift in self.shifts:
            bit = (last >> shift) & 1
            ones = np.zeros(self.length + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.length - int(ones[-1]))
            last = np.concatenate([last[bit == 0], last[bit == 1]])

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``upto`` letters of the transform."""

        begin = np.zeros_like(upto)
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros):
            set_bit = (symbols >> shift) & 1 == 1
            upto = np.where(set_bit, zeros + ones[upto], upto - ones[upto])
            begin = np.where(set_bit, zeros + ones[begin], begin - ones[begin])
        return upto - begin

    def symbols(self, rows: np.ndarray) -> np.ndarray:
        """Letters of the transform at ``rows``."""

        found = np.zeros_like(rows)
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros):
            set_bit = ones[rows + 1] - ones[rows] == 1
            found |= set_bit.astype(np.int64) << shift
            rows = np.where(set_bit, zeros + ones[rows], rows - ones[rows])
        return found

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows of ``patterns`` (one phrase each, equal lengths) occur, and the range of suffixes of each."""

        alive = np.arange(len(patterns))
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.length, np.int64)
        for place in range(patterns.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            symbol = patterns[alive, place]
            low = self.before[symbol] + self.rank(symbol, low)
            high = self.before[symbol] + self.rank(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one and count the steps."""

        at = np.empty(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        for step in range(SAMPLE):
            done = self.sampled[rows]
            at[todo[done]] = self.samples[self.sample_rank[rows[done]]] + step
            todo, rows = todo[~done], rows[~done]
            if not len(todo):
                break
            symbol = self.symbols(rows)
            rows = self.before[symbol] + self.rank(symbol, rows)
        return at
