"""A compressed full-text index over integer sequences, queried many patterns at a time.

The Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with rank
blocks. Backward search runs on arrays of patterns: one step narrows all of their suffix
intervals by one symbol.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, by prefix doubling."""
    size = len(symbols)
    rank = symbols.astype(np.int64) + 1
    known = 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        later = np.zeros(size, np.int64)
        later[: size - known] = rank[known:]
        key = rank * (int(rank.max(initial=0)) + 1) + later
        order = np.argsort(key, kind="stable")
        new = np.empty(size, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        rank = new
        known *= 2
        if len(rank) and rank.max() == size:
            break
    return order


class WaveletMatrix:
    """One row of bits a level, highest bit first; zeros go left, ones right."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            ones = (symbols >> level & 1).astype(np.uint8)
            padded = np.zeros((len(ones) // 64 + 1) * 64, np.uint8)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(ones) - ones.sum()))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def trace(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where a prefix of `places` symbols ends among equal symbols on the last level."""
        for depth in range(self.levels):
            word = places >> 6
            below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.blocks[depth][word] + np.bitwise_count(self.bits[depth][word] & below)
            right = symbols >> (self.levels - 1 - depth) & 1
            places = np.where(right == 1, self.zeros[depth] + ones, places - ones)
        return places


class FMIndex:
    """Index of a sequence of symbols 0 .. alphabet - 1, good for patterns up to `depth`."""

    def __init__(self, symbols: np.ndarray, alphabet: int, depth: int):
        self.order = suffix_order(symbols, depth)
        self.size = len(symbols)
        transform = symbols[self.order - 1]  # the first suffix is preceded by the last symbol
        self.matrix = WaveletMatrix(transform, alphabet)
        counts = np.bincount(symbols, minlength=alphabet)
        every = np.arange(alphabet)
        first = self.matrix.trace(every, np.zeros(alphabet, np.int64))
        self.base = np.concatenate([[0], np.cumsum(counts)[:-1]]) - first

    def step(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.base[symbols] + self.matrix.trace(symbols, places)

    def matched(self, text: np.ndarray, starts: np.ndarray, length: int, weights: np.ndarray, least: int) -> np.ndarray:
        """Which length-long patterns text[start:] occur with weight `least` or more.

        weights has a weight for each place of the indexed sequence. A pattern is given
        up as soon as what is matched of it is too rare, so the number of steps a
        pattern takes is its matching statistic at that place.
        """
        total = np.concatenate([[0], np.cumsum(weights[self.order])])
        alive = np.arange(len(starts))
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), self.size, np.int64)
        for offset in range(length - 1, -1, -1):
            symbol = text[starts[alive] + offset]
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = both[: len(alive)], both[len(alive) :]
            enough = total[high] - total[low] >= least
            alive, low, high = alive[enough], low[enough], high[enough]
            if not len(alive):
                break
        found = np.zeros(len(starts), bool)
        found[alive] = True
        return found
