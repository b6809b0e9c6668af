"""Token ids of words, found once per distinct word.

Tokenizers that never join two words give each word the same ids wherever it stands. A cache
keeps them in flat arrays under the word's hash; a batch of texts costs one sort of its word hashes
and one call of the encoder for the words that are new.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from maskwork.llm.words import Powers, Words, mix, space_table

CHUNK = 2_000_000


class WordCache:
    """``encode`` maps a list of words to (ids of all, number of ids of each)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000) -> None:
        self.encode, self.limit = encode, limit
        self.table, self.powers = space_table(), Powers()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def slots_of(self, texts: list) -> tuple[Words, np.ndarray]:
        """The words of the texts and the cache slot of each word."""
        words = Words(texts, self.table, self.powers)
        # the word's length keeps two words apart whose hashes meet
        keys = words.hashes ^ mix((words.ends - words.starts).astype(np.uint64))
        unique, first, where = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            joined = words.joined
            spelled = [joined[a:b] for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())]
            ids, lengths = self.encode(spelled)
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.slots = np.insert(self.slots, at[new], np.arange(len(self.lengths), len(self.lengths) + len(new)))
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return words, self.slots[np.searchsorted(self.keys, unique)][where]

    def ids_of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and their bounds per text."""
        words, slots = self.slots_of(texts)
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        ids = self.ids[np.repeat(self.starts[slots], lengths) + inside]
        return ids, np.concatenate([[0], ends])[words.bounds]
