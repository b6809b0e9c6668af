"""Benchmark decontamination by SimHash of item-sized windows.

A text is its five-word shingles; an item of fewer words is one shingle of all of them. A shingle weighs
one over the number of items of the whole benchmark that hold it, and nothing if no item does. A document
holds an item if a stretch of the item's length, and ``SLACK`` words on both sides, holds 0.8 of its weight.

1. Each item has a fingerprint of 128 bits: signs of the sums, over its shingles, of a random number per bit
   times the root of the weight. The cosine of an item and a stretch is then the root of the share held, so at
   0.8 a bit differs with probability 0.148 and 18.9 of 128 do, give or take 4.
2. In documents the stretch that begins at each weighted shingle is fingerprinted for every length of items, by
   running sums. One whose whole weight is under 0.8 of the lightest item's is passed over; it can hold none.
3. Eight 16-bit blocks index the items' fingerprints, each under all values within 2 bits, and are asked for all
   values within 1 bit: every fingerprint within 8 * 3 + 7 = 31 bits is found, three deviations beyond the mean.
4. What the fingerprints name, and nothing else, is compared exactly by weighted shingles.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.llm.words import Powers, Words, chunks, mix, plain_table
from maskwork.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
BITS, BLOCKS = 128, 8
ITEM_FLIPS, ASKED_FLIPS = 2, 1
RADIUS = BLOCKS * (ITEM_FLIPS + ASKED_FLIPS) + BLOCKS - 1
SLACK = 2
BLOCK_ITEMS, BLOCK_CHARS = 2000, 8_000_000
UNIT = 1 << 48
EDGE = 1e-9
PIECE = 4096
_SEEDS = mix(np.arange(1, BITS // 8 + 1, dtype=np.uint64))


def _flips(most: int) -> np.ndarray:
    """All 16-bit numbers of at most ``most`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(16), n)])


def _sums(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of the shingles' random numbers, one column per bit; the first row is zero."""
    drawn = mix(hashes[:, None] + _SEEDS).view(np.uint8).astype(np.int64)
    out = np.zeros((len(hashes) + 1, BITS), np.int64)
    np.cumsum((2 * drawn - 255) * sizes[:, None], axis=0, out=out[1:])
    return out


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups of these sizes laid end to end: the group of each place, and the place inside it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Known:
    """Shingles of ``k`` words that items hold, with their weights, sorted by hash."""

    def __init__(self, own: list[np.ndarray], weights: dict[int, int]) -> None:
        self.hashes = np.unique(np.concatenate(own))
        self.weights = np.array([weights[s] for s in self.hashes.tolist()]) / UNIT
        self.sizes = np.maximum(np.rint(np.sqrt(self.weights) * (1 << 16)), 1).astype(np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._low(self.hashes)] = True

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(0xFFFFF)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` of known shingles, and which each is."""
        at = np.flatnonzero(self.filter[self._low(hashes)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[at]
        return at[same], place[same]

    def prints(self, places: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs ``first`` to ``last`` of a list of known shingles."""
        low, high = int(first.min()), int(last.max())
        sums = _sums(self.hashes[places[low:high]], self.sizes[places[low:high]])
        return np.packbits(sums[last - low] > sums[first - low], axis=1).view(np.uint64)


class ItemIndex:
    """Fingerprints and weighted shingles of one block of items.

    ``held`` has the number of items that hold a shingle, where it is above one; without it the block is all.
    """

    def __init__(self, ids: list, texts: list, held: dict[int, int] | None = None) -> None:
        self.ids, self.table, self.powers = ids, plain_table(), Powers()
        words = Words(texts, self.table, self.powers)
        self.lengths = np.diff(words.bounds)
        self.shingles = item_shingles(words)
        if held is None:
            held = Counter(s for own in self.shingles for s in own.tolist())
        # whole numbers, so that sums are the same in any order
        self.weights = {s: UNIT // held.get(s, 1) for own in self.shingles for s in own.tolist()}
        self.totals = [sum(self.weights[s] for s in own.tolist()) for own in self.shingles]
        self.classes = [int(n) for n in np.unique(self.lengths) if n]
        self.known = {k: _Known([own for own, n in zip(self.shingles, self.lengths) if min(n, SHINGLE) == k], self.weights)
                      for k in sorted({min(n, SHINGLE) for n in self.classes})}
        self.prints = np.zeros((len(ids), BITS // 64), np.uint64)
        for k, known in self.known.items():
            hashes, bounds = words.shingles(k)
            for i in np.flatnonzero(np.minimum(self.lengths, SHINGLE) == k).tolist():
                places = known.find(hashes[bounds[i] : bounds[i + 1]])[1]
                self.prints[i] = known.prints(places, np.array([0]), np.array([len(places)]))[0]
        items = np.flatnonzero(self.lengths)
        keys = self._keys(self.prints[items], np.searchsorted(self.classes, self.lengths[items]), _flips(ITEM_FLIPS))
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys = keys.ravel()[order]
        self.entries = np.repeat(items, keys[0].size if len(items) else 0)[order]
        self.asked = _flips(ASKED_FLIPS)

    @staticmethod
    def _keys(prints: np.ndarray, kinds: np.ndarray | int, flips: np.ndarray) -> np.ndarray:
        """(print, block, flip): the length class, the block's number and its changed value in one number."""
        value = prints.view(np.uint16).astype(np.int64)[:, :, None] ^ flips
        kinds = np.broadcast_to(np.asarray(kinds, np.int64), len(prints))
        return (kinds[:, None, None] << 19) | (np.arange(BLOCKS)[:, None] << 16) | value

    def near(self, prints: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``prints``, item) of all items of a class within the radius, some more than once."""
        keys = self._keys(prints, kind, self.asked).reshape(len(prints), -1)
        low, high = (np.searchsorted(self.keys, keys.ravel(), side=side) for side in ("left", "right"))
        group, inside = _spread(high - low)
        place, item = group // keys.shape[1], self.entries[low[group] + inside]
        close = np.bitwise_count(prints[place] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return place[close], item[close]

    def _candidates(self, known: _Known, hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
        """Rows (text, item) that the fingerprints name, each once."""
        at, places = known.find(hashes)
        if not len(at):
            return np.zeros((0, 2), np.int64)
        owner = np.searchsorted(bounds, at, side="right") - 1
        weight = np.concatenate([[0.0], np.cumsum(known.weights[places])])
        pairs = []
        for kind, length in enumerate(self.classes):
            if min(length, SHINGLE) != k:
                continue
            last = np.searchsorted(at, np.minimum(at + length + 2 * SLACK - k + 1, bounds[owner + 1]))
            lightest = min(self.totals[i] for i in np.flatnonzero(self.lengths == length).tolist()) / UNIT
            first = np.flatnonzero(weight[last] - weight[:-1] >= (THRESHOLD - 1e-6) * lightest - 1e-9)
            for some in np.split(first, np.flatnonzero(np.diff(first // PIECE)) + 1):
                if not len(some):
                    continue
                prints, back = np.unique(known.prints(places, some, last[some]), axis=0, return_inverse=True)
                held = np.unique(np.stack([back.ravel(), owner[some]], axis=1), axis=0)  # (print, text)
                place, item = self.near(prints, kind)
                starts = np.searchsorted(held[:, 0], np.arange(len(prints) + 1))
                group, inside = _spread(starts[place + 1] - starts[place])
                pairs.append(np.unique(np.stack([held[starts[place[group]] + inside, 1], item[group]], axis=1), axis=0))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)

    def matches(self, texts: list) -> list[tuple[int, int, float]]:
        """(text, item, similarity) of every item found in a text, best stretch each."""
        words = Words(texts, self.table, self.powers)
        out = []
        for k, known in self.known.items():
            shingled = words.shingles(k)
            for doc, item in self._candidates(known, *shingled, k).tolist():
                found = self._similarity(shingled, doc, item, k)
                if found >= THRESHOLD - EDGE:
                    out.append((doc, item, found))
        return out

    def _similarity(self, shingled: tuple, doc: int, item: int, k: int) -> float:
        """The most that a stretch of the item's length, and ``SLACK`` on both sides, holds of the item."""
        mine = shingled[0][shingled[1][doc] : shingled[1][doc + 1]]
        own = self.shingles[item]
        places = np.flatnonzero(own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine)
        found = mine[places].tolist()
        width = int(self.lengths[item]) + 2 * SLACK - k + 1
        inside: dict[int, int] = {}
        most = now = first = 0
        for at, shingle in zip(places.tolist(), found):
            n = inside[shingle] = inside.get(shingle, 0) + 1
            now += self.weights[shingle] if n == 1 else 0
            while places[first] <= at - width:
                gone = found[first]
                inside[gone] -= 1
                now -= 0 if inside[gone] else self.weights[gone]
                first += 1
            most = max(most, now)
        return most / self.totals[item]


def item_shingles(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; one shorter than a shingle is a single one of all its words."""
    lengths = np.diff(words.bounds)
    out = [np.zeros(0, np.uint64)] * len(lengths)
    for k in range(1, SHINGLE + 1):
        hashes, bounds = words.shingles(k)
        for i in np.flatnonzero(np.minimum(lengths, SHINGLE) == k).tolist():
            out[i] = np.unique(hashes[bounds[i] : bounds[i + 1]])
    return out


def _held(items: DataFrame) -> DataFrame:
    """block, shingle and the number of items of the whole benchmark that hold it, where that is above one."""

    def run(batches):
        table, powers = plain_table(), Powers()
        for batch in batches:
            blocks, texts = batch.column("block").to_numpy(), batch.column("text").to_pylist()
            for a, b in chunks(texts):
                own = item_shingles(Words(texts[a:b], table, powers))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(blocks[a:b], [len(x) for x in own]), pa.int64()),
                     pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["block", "shingle"])

    shingles = materialise(items.select("block", "text").mapInArrow(run, "block bigint, shingle bigint"), "item_shingles")
    counts = materialise(shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "held")
    return materialise(shingles.distinct().join(counts, "shingle"), "held_by_block")


def _item_blocks(benchmark: DataFrame):
    """Ids, texts and shingle counts of the items, block by block, so that none grows with the table."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    rows, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, ceil(rows / BLOCK_ITEMS), ceil(chars / BLOCK_CHARS))
    items = items.withColumn("block", F.coalesce(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)), F.lit(0)).cast("bigint"))
    held = _held(items) if blocks > 1 else None  # a single block counts its own
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()
        counts = None if held is None else {r[0] & (2**64 - 1): r[1] for r in held.where(F.col("block") == block).select("shingle", "n").collect()}
        yield [r[0] for r in rows], [r[1] or "" for r in rows], counts


def leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity): every item that a document holds, whole tables.

    Null or empty texts hold nothing and items without a word are held by nothing. A null doc_id or
    item_id comes back null, a repeated row as often as it is there. Other columns are ignored.
    """
    out = None
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)  # at most about BLOCK_ITEMS texts and BLOCK_CHARS characters

        def run(batches, shared=shared):
            index = ItemIndex(*shared.value)
            for batch in batches:
                docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for a, b in chunks(texts):
                    found = index.matches(texts[a:b])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([docs[a + d] for d, _, _ in found], pa.int64()),
                        pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
                        pa.array([v for _, _, v in found], pa.float64())], ["doc_id", "item_id", "similarity"])

        part = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
            run, "doc_id bigint, item_id bigint, similarity double")
        out = part if out is None else out.union(part)
    return out


def drop_leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with; no row is moved."""
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = ItemIndex(*shared.value)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                keep = np.ones(len(texts), bool)
                for a, b in chunks(texts):
                    keep[[a + d for d, _, _ in index.matches(texts[a:b])]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
