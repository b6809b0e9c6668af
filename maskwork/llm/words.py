"""Words of many texts at once, as 64-bit hashes in numpy arrays.

All functions take a list of texts (``None`` counts as empty) and work on one array of
code points, so the cost per word is a few array operations and no Python call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
CHUNK_CHARS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def space_table() -> np.ndarray:
    """Values of code points for words ``[^\\x20\\x09-\\x0D]+``: 0 separates words."""
    table = mix(np.arange(1, 0x10001, dtype=np.uint64)) | np.uint64(1)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def plain_table() -> np.ndarray:
    """Values for normalised words: lower-case letters and digits, all else separates."""
    code = np.arange(0x10000, dtype=np.uint64)
    lower = np.fromiter((ord(chr(c).lower()[0]) if not 0xD800 <= c < 0xE000 and chr(c).isalnum() else 0 for c in range(0x10000)),
                        np.uint64, 0x10000)
    table = mix(lower + np.uint64(1)) | np.uint64(1)
    table[(lower == 0) & (code >= 0)] = 0
    return table


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` characters; a longer text is its own range."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + 1
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


class Powers:
    """Powers of the hash's base and of its inverse, grown as far as a text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) >= n:
            return
        inverse = pow(_STEP, -1, 1 << 64)
        for name, base in (("up", _STEP), ("down", inverse)):
            powers = np.full(n + n // 4 + 1, base, np.uint64)
            powers[0] = 1
            setattr(self, name, np.multiply.accumulate(powers))


class Words:
    """Words of a list of texts.

    ``hashes`` and ``starts`` have one entry per word; ``bounds[d]:bounds[d + 1]`` are the
    words of text ``d``.  ``starts`` and ``ends`` are positions in ``joined``, the texts
    joined by newlines, whose texts begin at ``offsets``.
    """

    def __init__(self, texts: list, table: np.ndarray, powers: Powers) -> None:
        joined = "\n".join(t or "" for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        value = table[np.minimum(code, 0xFFFF)]
        high = np.flatnonzero(code > 0xFFFF)
        if len(high):
            value[high] = mix(code[high].astype(np.uint64)) | np.uint64(1)
        inside = value != 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[0::2], edge[1::2]
        powers.to(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(value * powers.up[: len(code)], out=total[1:])
        self._total, self._powers = total, powers
        self.hashes = self._between(self.starts, self.ends)
        self.joined, self.code = joined, code
        lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def _between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._total[ends] - self._total[starts]) * self._powers.down[starts])

    def prefixes(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` characters of each word."""
        return self._between(self.starts, np.minimum(self.starts + length, self.ends))

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` consecutive words of one text and their bounds per text."""
        counts = np.diff(self.bounds)
        kept = np.maximum(counts - k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(kept)])
        n = max(len(self.hashes) - k + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled = (rolled + self.hashes[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        rolled = mix(rolled)
        owner = self.owner
        return rolled[owner[:n] == owner[k - 1 :]] if n else rolled, bounds
