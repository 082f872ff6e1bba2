"""FM-index over a sequence of small integers: wavelet matrix, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; zeros are separators, each smaller than all symbols and than later zeros."""
    n = len(text)
    separators = np.cumsum(text == 0)
    rank = np.where(text == 0, separators - 1, text + separators[-1]).astype(np.int64) if n else text.astype(np.int64)
    step = 1
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if n else ordered
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix counts per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(now) - self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        begin, end = np.zeros_like(places), places
        for depth, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[depth], self.zeros[depth]
            one = ((symbol >> level) & 1).astype(bool)
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - begin


class FMIndex:
    """Index of one text whose separators are zeros; it starts with one."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8) -> None:
        order = suffix_order(text)
        self.last = text[order - 1]  # the symbol before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.wavelet = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        # Positions behind a separator are kept too, so that no walk has to pass one.
        self.kept = (order % sample == 0) | (self.last == 0)
        self.position = np.where(self.kept, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows of equal length) that occur: their numbers and their rows of the index, from and to."""
        number = np.arange(len(patterns))
        symbol = patterns[:, -1]
        low, high = self.before[symbol], self.before[symbol + 1]
        for place in range(patterns.shape[1] - 2, -1, -1):
            alive = low < high
            number, low, high = number[alive], low[alive], high[alive]
            if not len(number):
                break
            symbol = patterns[number, place]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
        alive = low < high
        return number[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text: walk backwards to a sampled one."""
        found, steps = np.full(len(rows), -1), np.zeros(len(rows), dtype=np.int64)
        open_, now = np.arange(len(rows)), rows
        while len(open_):
            here = self.kept[now]
            found[open_[here]] = self.position[now[here]] + steps[open_[here]]
            open_, now = open_[~here], now[~here]
            steps[open_] += 1
            symbol = self.last[now]
            now = self.before[symbol] + self.wavelet.rank(symbol, now)
        return found
