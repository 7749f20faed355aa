"""An FM-index over words: bounded suffix order, wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(symbols, positions): how often each symbol stands before each position.  Bits are packed, counts kept per 64."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = ((seq >> level) & 1).astype(np.uint8)
            packed = np.zeros(len(seq) // 64 + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            zeros = len(seq) - int(bit.sum())
            self.levels.append((level, packed, before.astype(np.int32), zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.first = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, before, zeros in self.levels:
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & below)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.first[symbols]


class FmIndex:
    """Backward search for patterns of at most ``depth`` symbols in ``text`` (symbols from 1, 0 separates).

    Suffixes are ordered by their first ``depth`` symbols or more, which is all that such patterns need: the step from
    P to cP compares |P| + 1 symbols.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        n = len(text)
        key, width = text.astype(np.int64), 1
        while True:
            order = np.argsort(key, kind="stable")
            if width >= depth:
                break
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            key = rank * (n + 2)
            key[:-width] += rank[width:]
            width *= 2
        self.suffixes = order
        self.bwt = WaveletMatrix(text[order - 1].astype(np.int64), n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])

    def search(self, text: np.ndarray, at: np.ndarray, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the suffixes that begin with text[at : at + length]; 0, 0 once fewer than ``least`` are left."""
        low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        symbol = text[at + (length - 1)]
        lo, hi = self.before[symbol], self.before[symbol + 1]
        for back in range(length - 2, -1, -1):
            keep = hi - lo >= least
            live, lo, hi = live[keep], lo[keep], hi[keep]
            symbol = text[at[live] + back]
            base = self.before[symbol]
            lo, hi = base + self.bwt.rank(symbol, lo), base + self.bwt.rank(symbol, hi)
        keep = hi - lo >= least
        low[live[keep]], high[live[keep]] = lo[keep], hi[keep]
        return low, high
