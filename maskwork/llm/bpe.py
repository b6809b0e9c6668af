"""Byte-pair encoding of many words at once, with the merges of a public tokenizer file.

The file's own library encodes a word in about ten microseconds. Here the words of a batch are rows of
an array of symbols, and every round joins, in each row, the leftmost pair of the lowest rank. Words
with characters whose case or class could differ between libraries go to the library itself; tests hold
both against each other.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

_NONE = np.iinfo(np.int32).max
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LONGEST = 24
_POINTS = ".,;:!?\"'()*$%&#-"
PLAIN_BELOW = 0x250


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    moved = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + moved.index(b)) for b in range(256)]


class WordBpe:
    """Ids of words under a vocabulary with word ends (lower case, white space dropped)."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.final = np.array([vocabulary[c + suffix] for c in letters], np.int32)
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.marks = [t["content"] for t in spec["added_tokens"]]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        keys = left << np.uint64(32) | right
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.bits = int(len(keys)).bit_length() + 3
        self.slot_keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.slot_ranks = np.full(1 << self.bits, _NONE, np.int32)
        self.probes = self._fill(keys)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> int:
        """Open addressing by linear steps; returns how many steps the farthest key needs."""
        farthest, size = 0, len(self.slot_keys)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist())):
            steps = 0
            while self.slot_ranks[(at + steps) % size] != _NONE:
                steps += 1
            self.slot_keys[(at + steps) % size], self.slot_ranks[(at + steps) % size] = key, rank
            farthest = max(farthest, steps)
        return farthest + 1

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._home(keys)
        held = self.slot_keys[at]
        ranks = np.where(held == keys, self.slot_ranks[at], _NONE)
        open_ = np.flatnonzero((held != keys) & (self.slot_ranks[at] != _NONE))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at_step = (at.ravel()[open_] + step) % len(self.slot_keys)
            hit = self.slot_keys[at_step] == keys.ravel()[open_]
            ranks.ravel()[open_[hit]] = self.slot_ranks[at_step[hit]]
            open_ = open_[~hit & (self.slot_ranks[at_step] != _NONE)]
        return ranks

    def _merge(self, grid: np.ndarray, lengths: np.ndarray) -> None:
        """Merges the rows of ``grid`` in place; cells beyond a row's length hold -1."""
        rows = np.arange(len(grid))
        now, left = grid.copy(), lengths.copy()
        width = grid.shape[1]
        columns = np.arange(width)
        ranks = self._ranks(np.maximum(now[:, :-1], 0), np.maximum(now[:, 1:], 0))
        ranks[columns[:-1][None, :] >= left[:, None] - 1] = _NONE
        while len(rows):
            where = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), where]
            done = best == _NONE
            if done.any():
                grid[rows[done]], lengths[rows[done]] = now[done], left[done]
                go = ~done
                rows, now, left, ranks, where, best = rows[go], now[go], left[go], ranks[go], where[go], best[go]
                if not len(rows):
                    return
            take = np.minimum(columns[None, :] + (columns[None, :] > where[:, None]), width - 1)
            now = np.take_along_axis(now, take, 1)
            every = np.arange(len(rows))
            now[every, where] = self.made[best]
            left = left - 1
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], width - 2), 1)
            ranks[columns[:-1][None, :] >= left[:, None] - 1] = _NONE
            # only the two pairs beside the new symbol change
            for side in (-1, 0):
                pair = where + side
                fits = np.flatnonzero((pair >= 0) & (pair < left - 1))
                ranks[fits, pair[fits]] = self._ranks(now[fits, pair[fits]], now[fits, pair[fits] + 1])

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``LONGEST`` bytes, and their number per piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = max(2, int(lengths.max(initial=2)))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        grid = np.full((len(pieces), width), -1, np.int32)
        filled = np.arange(width)[None, :] < lengths[:, None]
        grid[filled] = self.inner[flat]
        every = np.arange(len(pieces))
        grid[every, lengths - 1] = self.final[flat[np.cumsum(lengths) - 1]]
        self._merge(grid, lengths)
        return grid[np.arange(width)[None, :] < lengths[:, None]], lengths

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their number per word; exact for any text without a mark of the file."""
        plain: list[bytes] = []
        owner: list[int] = []
        hard: list[int] = []
        find, marks, first_hard = self.pattern.findall, self.marks, chr(PLAIN_BELOW)
        for n, word in enumerate(words):
            if word.isascii() and word.isalpha() and len(word) <= LONGEST:
                plain.append(word.lower().encode())
                owner.append(n)
                continue
            core = word.rstrip(_POINTS)  # a word and one run of points are two pieces
            if core.isascii() and core.isalpha() and len(word) <= LONGEST:
                plain += (core.lower().encode(), word[len(core) :].encode())
                owner += (n, n)
                continue
            if len(word) > 200 or (not word.isascii() and max(word) >= first_hard) or any(m in word for m in marks):
                hard.append(n)
                continue
            own = [p.encode() for p in find(unicodedata.normalize("NFC", word).lower())]
            if own and max(map(len, own)) > LONGEST:
                hard.append(n)
                continue
            plain += own
            owner += [n] * len(own)
        parts, sizes, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # short rows and long rows apart, so that few cells stay empty
        held = np.array(owner, np.int64)
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        for low, high in ((1, 6), (7, 12), (13, LONGEST)):
            mine = np.flatnonzero((lengths >= low) & (lengths <= high))
            for at in range(0, len(mine), 100_000):
                chosen = mine[at : at + 100_000]
                ids, counts = self.pieces([plain[i] for i in chosen])
                parts.append(ids)
                sizes.append(counts)
                owners.append(chosen)
        for at in range(0, len(hard), 1000):
            found = [e.ids for e in self.library.encode_batch([words[n] for n in hard[at : at + 1000]], add_special_tokens=False)]
            parts.append(np.fromiter((i for f in found for i in f), np.int32))
            sizes.append(np.array([len(f) for f in found], np.int64))
            owners.append(len(plain) + np.arange(at, at + len(found)))
        held = np.concatenate([held, np.array(hard, np.int64)])
        ids, counts, piece = np.concatenate(parts), np.concatenate(sizes), np.concatenate(owners)
        # back to the order of the words, and of the pieces inside a word
        order = np.lexsort((piece, held[piece])) if len(piece) else piece
        starts = np.cumsum(counts) - counts
        lengths = counts[order]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = ids[np.repeat(starts[order], lengths) + inside]
        return out, np.bincount(held[piece], counts, minlength=len(words)).astype(np.int64)
