"""A K2-treap: a quadtree over a sparse grid of non-negative weights whose cells hold their maxima.

Per level there is one four-bit mask per non-empty cell (which quadrants are non-empty) and one maximum. Children
lie in the order of their parents, so their place is a running count of mask bits and no pointer is stored. In
its byte form a maximum is the difference to its parent's, and the whole is compressed.

``top`` finds the columns with the largest weighted sums over given rows. The rows' paths go down the tree
together: a range of columns carries one cell per row that has anything there, and the sum of weight times
maximum bounds all its columns. Ranges are opened best bound first, in batches, until no bound reaches the
k-th sum found.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)
SPREAD = 64  # ranges the descent splits into before it goes best first
BATCH = 16  # ranges opened at a time


def _spread(x: np.ndarray) -> np.ndarray:
    """The 32 low bits, a zero between any two."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class K2Treap:
    def __init__(self, masks: list[np.ndarray], peaks: list[np.ndarray]) -> None:
        self.height = len(masks)
        self._levels = masks, peaks
        sizes = np.array([0, *[len(p) for p in peaks]])
        begins = np.cumsum(sizes)
        # all levels in one array each; leaves have an empty mask
        self.masks = np.concatenate([*masks, np.zeros(len(peaks[-1]), np.uint8)])
        self.peaks = np.concatenate(peaks).astype(np.int64)
        kids = _BITS[self.masks]
        self.child = np.cumsum(kids) - kids + (begins[1] if len(begins) > 1 else 0)

    @classmethod
    def build(cls, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> K2Treap:
        """From distinct (row, col) pairs."""
        top = int(max(rows.max(initial=0), cols.max(initial=0)))
        height = top.bit_length()
        code = _spread(rows) << np.uint64(1) | _spread(cols)
        order = np.argsort(code)
        code, peak = code[order], weights[order].astype(np.uint32)
        masks, peaks = [], [peak]
        for _ in range(height):
            parent = code >> np.uint64(2)
            begins = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
            bit = np.left_shift(1, (code & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(bit, begins) if len(begins) else bit)
            peaks.append(np.maximum.reduceat(peaks[-1], begins) if len(begins) else peaks[-1])
            code = parent[begins]
        return cls(masks[::-1], peaks[::-1])

    def to_bytes(self) -> bytes:
        masks, peaks = self._levels
        drops = [np.repeat(up, _BITS[mask]) - down for mask, up, down in zip(masks, peaks, peaks[1:])]
        head = struct.pack(f"<{len(peaks) + 1}q", len(peaks), *[len(p) for p in peaks])
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head, peaks[0].astype("<u4").tobytes(), *[m.tobytes() for m in masks],
                                                                   *[d.astype("<u4").tobytes() for d in drops]]))

    @classmethod
    def from_bytes(cls, data: bytes) -> K2Treap:
        raw = zstandard.ZstdDecompressor().decompress(data)
        levels = struct.unpack_from("<q", raw)[0]
        sizes = struct.unpack_from(f"<{levels}q", raw, 8)
        at = 8 * (levels + 1)

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, kind, n, at)
            at += part.nbytes
            return part

        peaks = [take(sizes[0], "<u4")]
        masks = [take(n, "u1") for n in sizes[:-1]]
        for mask, n in zip(masks, sizes[1:]):
            peaks.append(np.repeat(peaks[-1], _BITS[mask]) - take(n, "<u4"))
        return cls(masks, peaks)

    def _open(self, level: int, ranges: np.ndarray, owner: np.ndarray, cell: np.ndarray, term: np.ndarray, rows: np.ndarray):
        """Both halves of every range: their numbers, and of each (range, row) that goes on its range's place, cell and row."""
        low = rows[term] >> (self.height - 1 - level) & 1
        mask, child = self.masks[cell].astype(np.int64), self.child[cell]
        owners, cells, terms = [], [], []
        for half in (0, 1):
            quadrant = low * 2 + half
            on = np.flatnonzero(mask >> quadrant & 1)
            owners.append(owner[on] * 2 + half)
            cells.append(child[on] + _BITS[mask[on] & (1 << quadrant[on]) - 1])
            terms.append(term[on])
        owner = np.concatenate(owners)
        both = (ranges[:, None] * 2 + np.arange(2)).ravel()
        return both, owner, np.concatenate(cells), np.concatenate(terms)

    def _bounds(self, n: int, owner: np.ndarray, cell: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum of weight times maximum per range; in two halves, so that floating sums are exact."""
        part = weight * self.peaks[cell]
        high = np.bincount(owner, part >> 26, n).astype(np.int64)
        return (high << 26) + np.bincount(owner, part & (1 << 26) - 1, n).astype(np.int64)

    @staticmethod
    def _keep(keep: np.ndarray, ranges: np.ndarray, bounds: np.ndarray, owner: np.ndarray, cell: np.ndarray, term: np.ndarray):
        place = np.cumsum(keep) - 1
        on = keep[owner]
        return ranges[keep], bounds[keep], place[owner[on]], cell[on], term[on]

    def top(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and sums of the ``k`` largest positive sums, largest first, equal sums by column."""
        best_col, best_sum = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(rows) or not len(self._levels[1][-1]):
            return best_col, best_sum
        least = 1
        term = np.arange(len(rows))
        state = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), term)
        level = 0

        def step(level, state):
            ranges, _, owner, cell, term = state
            ranges, owner, cell, term = self._open(level, ranges, owner, cell, term, rows)
            bounds = self._bounds(len(ranges), owner, cell, weights[term])
            return self._keep(bounds >= least, ranges, bounds, owner, cell, term)

        while level < self.height and len(state[0]) < SPREAD:
            state = step(level, state)
            level += 1
        if not level:
            state = (state[0], self._bounds(1, state[2], state[3], weights[term]), *state[2:])
        order = np.argsort(-state[1], kind="stable")
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            if state[1][chosen[0]] < least:
                break
            keep = np.zeros(len(order), bool)
            keep[chosen] = state[1][chosen] >= least
            part, below = self._keep(keep, *state), level
            while below < self.height and len(part[0]):
                part = step(below, part)
                below += 1
            cols, sums = np.concatenate([best_col, part[0]]), np.concatenate([best_sum, part[1]])
            found = np.lexsort((cols, -sums))[:k]
            best_col, best_sum = cols[found], sums[found]
            if len(best_sum) == k:
                least = max(int(best_sum[-1]), 1)
        real = best_sum > 0
        return best_col[real], best_sum[real]
