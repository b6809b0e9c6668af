"""A compressed FM-index over words, searched for many patterns in step.

The index orders the suffixes of its text by their first ``depth`` words, which is all a search
for windows of that length needs. The transformed text is held in a wavelet matrix of bit
vectors with counts per 64 bits; a bit-per-row border array gives, for any row, the
rows that share its first ``depth - 1`` words, so that a match can give up its last word.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        size = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(size, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Counts of a symbol before a position, by one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels, self.zeros = [], []
        self.bits = max(1, int(sigma - 1).bit_length())
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.origin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, shift in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            ones = level.ones(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbols, at) - self.origin[symbols]


def _ordered(pairs: np.ndarray) -> np.ndarray:
    """Dense ranks of the values."""
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


class FmIndex:
    """Index of several runs of words, each followed by an end mark (symbol 0).

    ``weights`` says how often each run stands in the collection.
    """

    def __init__(self, runs: list[np.ndarray], weights: np.ndarray, depth: int) -> None:
        self.depth = depth
        lengths = np.array([len(r) for r in runs], np.int64)
        words = np.unique(np.concatenate(runs), return_inverse=True)[1].astype(np.int64) + 1
        size = int(lengths.sum() + len(runs))
        text = np.zeros(size, np.int64)
        self.ends = np.cumsum(lengths + 1) - 1  # places of the end marks
        mark = np.zeros(size, bool)
        mark[self.ends] = True
        text[~mark] = words
        self.text, self.lengths = text, lengths

        ranks, span = text, 1
        while span * 2 < depth:
            ranks, span = self._joined(ranks, span), span * 2
        shorter = self._joined(ranks, depth - 1 - span) if depth - 1 > span else ranks
        full = self._joined(ranks, depth - span) if depth > span else ranks
        order = np.argsort(full, kind="stable")
        self.wavelet = WaveletMatrix(text[order - 1], int(text.max()) + 1)
        counts = np.bincount(text, minlength=int(text.max()) + 1)
        self.first = np.cumsum(counts) - counts
        # rows that share depth - 1 words lie together; borders mark where such a group begins
        borders = np.flatnonzero(np.diff(shorter[order], prepend=-1))
        self.group = np.cumsum(np.diff(shorter[order], prepend=-1) != 0) - 1
        self.group_start = np.append(borders, size)
        spread = np.repeat(weights, lengths + 1)[order]
        self.weight = np.concatenate([[0], np.cumsum(spread)])

    @staticmethod
    def _joined(ranks: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by a place's rank, then by that ``shift`` words on."""
        after = np.zeros_like(ranks)
        after[: len(ranks) - shift] = ranks[shift:] + 1
        return _ordered(ranks << 32 | after)

    def repeated(self) -> list[np.ndarray]:
        """For each run, whether the window at each of its places occurs twice or more in all.

        All runs are streamed backwards together. A run's state is the row interval of its longest
        match, capped at ``depth`` words: a step adds the word to the left by one backward search,
        and before a step a full match drops its last word by moving to its group. The weight of
        an interval of full length is the number of occurrences.
        """
        flags = np.zeros(len(self.text), bool)
        order = np.argsort(-self.lengths, kind="stable")
        at = self.ends[order].copy()
        low, high = np.zeros(len(order), np.int64), np.full(len(order), len(self.text), np.int64)
        for step in range(int(self.lengths.max(initial=0))):
            live = np.searchsorted(-self.lengths[order], -step, side="left")  # runs longer than the step
            at, low, high = at[:live] - 1, low[:live], high[:live]
            if step >= self.depth:
                group = self.group[low]
                low, high = self.group_start[group], self.group_start[group + 1]
            symbol = self.text[at]
            low = self.first[symbol] + self.wavelet.rank(symbol, low)
            high = self.first[symbol] + self.wavelet.rank(symbol, high)
            if step + 1 >= self.depth:
                flags[at] = self.weight[high] - self.weight[low] >= 2
        starts = self.ends - self.lengths
        return [flags[s : s + max(n - self.depth + 1, 0)] for s, n in zip(starts.tolist(), self.lengths.tolist())]
