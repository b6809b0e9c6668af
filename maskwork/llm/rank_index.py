"""A learned index from the rank of a unit to the byte it starts at.

Over a text in UTF-8 the first bytes of its code points (or words, or lines) grow almost linearly with
their rank. A segment is a straight line from its first to its last boundary; where a boundary lies more
than ``TOLERANCE`` bytes off the line the segment is halved. What a line misses is stored as one signed
byte per boundary, so a look-up is a prediction and one exact correction.
"""

from __future__ import annotations

import numpy as np

TOLERANCE = 127  # a residual fits one signed byte
WINDOW = 1 << 20  # bytes that are indexed at once; bounds the memory besides the residuals


def char_starts(data: np.ndarray) -> np.ndarray:
    """True where a code point starts."""
    return (data & 0xC0) != 0x80


def word_starts(data: np.ndarray) -> np.ndarray:
    """True where a word starts after white space; white space belongs to the word before it."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    return ~space & np.concatenate([[False], space[:-1]])


def line_starts(data: np.ndarray) -> np.ndarray:
    """True after a line feed."""
    return np.concatenate([[False], data[:-1] == 0x0A])


UNITS = {"char": char_starts, "word": word_starts, "line": line_starts}


def _ranges(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all ranges one after another, and where each range begins among them."""
    sizes = highs - lows
    begins = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(lows - begins, sizes), begins


def fit(offsets: np.ndarray, tolerance: int = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rank and slope of each segment over ``offsets``, and the residual of every offset."""
    residuals = np.zeros(len(offsets), np.int8)
    firsts, slopes = [], []
    lows, highs = np.array([0]), np.array([len(offsets)])
    while len(lows):
        lines = (offsets[highs - 1] - offsets[lows]) / np.maximum(highs - 1 - lows, 1)
        at, begins = _ranges(lows, highs)
        sizes = highs - lows
        miss = offsets[at] - np.repeat(offsets[lows], sizes) - np.rint(
            np.repeat(lines, sizes) * (at - np.repeat(lows, sizes))).astype(np.int64)
        good = np.maximum.reduceat(np.abs(miss), begins) <= tolerance
        inside = np.repeat(good, sizes)
        residuals[at[inside]] = miss[inside]
        firsts.append(lows[good])
        slopes.append(lines[good])
        low, high = lows[~good], highs[~good]
        middle = (low + high) // 2
        lows, highs = np.concatenate([low, middle]), np.concatenate([middle, high])
    first, slope = np.concatenate(firsts), np.concatenate(slopes)
    order = np.argsort(first)
    return first[order], slope[order], residuals


class RankIndex:
    """Boundaries of the texts whose bytes lie in ``data`` one after another; text d is ``data[bounds[d]:bounds[d + 1]]``.

    ``first[d]`` is the rank of text d's first unit and ``first[d + 1]`` the rank after its last one.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str = "char", window: int = WINDOW) -> None:
        begins = np.unique(bounds[:-1][np.diff(bounds) > 0])  # a text that is not empty starts with a unit
        ranks, bases, slopes, residuals, before = [], [], [], [], []
        self.size, self.end = 0, len(data)
        for low in range(0, len(data), window):
            # one byte of context, as a word or a line starts where the byte before it says so
            part = data[max(low - 1, 0) : low + window]
            starts = UNITS[unit](part)[low > 0 :]
            here = begins[np.searchsorted(begins, low) : np.searchsorted(begins, low + window)]
            starts[here - low] = True
            offsets = np.flatnonzero(starts)
            known = bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, low + window)]
            before.append(self.size + np.searchsorted(offsets, known - low))
            if not len(offsets):
                continue
            first, slope, missed = fit(offsets)
            ranks.append(self.size + first)
            bases.append(low + offsets[first])
            slopes.append(slope)
            residuals.append(missed)
            self.size += len(offsets)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.ranks, self.bases, self.slopes = join(ranks, np.int64), join(bases, np.int64), join(slopes, np.float64)
        self.residuals = join(residuals, np.int8)
        self.first = np.concatenate([*before, np.full(len(bounds) - sum(map(len, before)), self.size)]).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The byte that each rank starts at; the rank after the last unit is the end."""
        out = np.full(len(ranks), self.end, np.int64)
        inside = ranks < self.size
        asked = ranks[inside]
        at = np.searchsorted(self.ranks, asked, side="right") - 1
        predicted = self.bases[at] + np.rint(self.slopes[at] * (asked - self.ranks[at])).astype(np.int64)
        out[inside] = predicted + self.residuals[asked]
        return out
