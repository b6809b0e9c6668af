"""Substring dedup: words in windows of 35 that occur anywhere else go.

To search every document in every shard would grow with the square of the corpus, so shards are
made by content. Each window is routed by its least six-word gram (its minimizer); consecutive
windows with one minimizer form a segment, and equal windows always meet under the same key. Keys
that occur once cannot hold a repeated window and are dropped. Grams that are keys of very
many segments rank behind all others, so that a common passage is a key only for windows that lie
in it whole. Segments of equal content are counted once with their number.

Shards of bounded size take whole keys: each builds a compressed FM-index of its segments
(``fm_index``), streams them through it backwards, and reports the stretches of windows whose
match of full length has two occurrences or more. The stretches are joined back to all
places of their segment, and each document drops the words they cover.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.llm.fm_index import FmIndex
from maskwork.llm.words import Powers, Words, chunks, mix, space_table
from maskwork.session import materialise

WINDOW = 35
GRAM = 6
SHARD_WORDS = 250_000
HEAVY_LEAST = 1000
HEAVY_SHARE = 20_000


class Segmenter:
    """Segments of the texts of a chunk, with ``heavy`` grams ranked last."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM, heavy: np.ndarray | None = None) -> None:
        self.window, self.gram = window, gram
        self.heavy = np.sort(heavy if heavy is not None else np.zeros(0, np.uint64))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.heavy & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.table, self.powers = space_table(), Powers()

    def _is_heavy(self, grams: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.filter[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.heavy, grams[maybe]), len(self.heavy) - 1)
        out = np.zeros(len(grams), bool)
        out[maybe] = self.heavy[at] == grams[maybe]
        return out

    def segments(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, key, content hash, first word and number of windows of each segment."""
        words = Words(texts, self.table, self.powers)
        hashes, n = words.hashes, len(words.hashes)
        width = self.window - self.gram + 1
        if n < self.window:
            empty = np.zeros(0, np.int64)
            return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
        grams = np.zeros(n - self.gram + 1, np.uint64)
        for j in range(self.gram):
            grams = (grams + hashes[j : j + len(grams)]) * np.uint64(0xD6E8FEB86659FD93)
        grams = mix(grams)
        # rank of a gram: heavy or not, then 33 bits of its hash, then its place (the leftmost of equal ones)
        order = (grams >> np.uint64(31)) << np.uint64(30) | np.arange(len(grams), dtype=np.uint64)
        if len(self.heavy):
            order |= self._is_heavy(grams).astype(np.uint64) << np.uint64(63)
        least, span = order, 1
        while span * 2 <= width:
            least, span = np.minimum(least[: len(least) - span], least[span:]), span * 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        owner = words.owner
        inside = owner[: len(least)] == owner[self.window - 1 :]
        place = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
        begins = inside.copy()
        begins[1:] &= ~((place[1:] == place[:-1]) & inside[:-1])
        first = np.flatnonzero(begins)
        after = np.flatnonzero(inside & ~np.append(inside[1:] & ~begins[1:], False))
        count = after - first + 1
        ends = first + count + self.window - 1
        total = np.zeros(n + 1, np.uint64)
        self.powers.to(n + 1)
        np.cumsum(hashes * self.powers.up[:n], out=total[1:])
        content = mix((total[ends] - total[first]) * self.powers.down[first] + count.astype(np.uint64))
        return owner[first], grams[place[first]], content, first - words.bounds[owner[first]], count


def _rows(documents: DataFrame) -> DataFrame:
    """doc, mark, text: a row is known by its id and its text, so null and repeated ids do not meet."""
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc"),
                            F.xxhash64(F.col("doc_id").isNull(), text).alias("mark"),
                            F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def _segments(rows: DataFrame, heavy: np.ndarray | None, window: int, gram: int) -> DataFrame:
    def run(batches):
        cutter = Segmenter(window, gram, heavy)
        for batch in batches:
            docs, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                owner, key, content, first, count = cutter.segments(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[a + owner]), pa.array(marks[a + owner]), pa.array(key.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["doc", "mark", "key", "content", "first", "windows"])

    return rows.select("doc", "mark", "text").mapInArrow(
        run, "doc bigint, mark bigint, key bigint, content bigint, first int, windows int")


def _keys(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        cutter = Segmenter(window, gram)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                key, n = np.unique(cutter.segments(texts[a:b])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return rows.select("text").mapInArrow(run, "key bigint, n bigint")


def _heavy(rows: DataFrame, window: int, gram: int) -> np.ndarray:
    """Keys of very many segments; under ``HEAVY_SHARE`` keys can hold one in ``HEAVY_SHARE`` of all each."""
    counts = materialise(_keys(rows, window, gram).groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {HEAVY_LEAST // 10}"), "keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(HEAVY_LEAST, total / HEAVY_SHARE)).select("key").toArrow()
    return found.column("key").to_numpy().astype(np.int64).view(np.uint64)


def _spelled(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, content, n and the words of each wanted segment, read from the document that was named for it."""
    lists = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "content", "n", "first", "words")).alias("segments"))

    def run(batches):
        table, powers = space_table(), Powers()
        for batch in batches:
            texts, lists = batch.column("text").to_pylist(), batch.column("segments").to_pylist()
            for a, b in chunks(texts):
                words = Words(texts[a:b], table, powers)
                out = []
                for d in range(b - a):
                    for s in lists[a + d]:
                        at = int(words.bounds[d]) + s["first"]
                        out.append((s["key"], s["content"], s["n"],
                                    words.joined[words.starts[at] : words.ends[at + s["words"] - 1]]))
                columns = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                    ["key", "content", "n", "words"])

    # rows that repeat id and text are one here
    once = texts.join(lists.hint("merge"), ["doc", "mark"]).select("segments", "text", "doc", "mark").dropDuplicates(["doc", "mark"])
    return once.select("segments", "text").mapInArrow(run, "key bigint, content bigint, n bigint, words string")


def _stretches(spelled: DataFrame, window: int) -> DataFrame:
    """key, content, starts, ends: stretches of repeated windows of each segment, from a shard's index."""

    def run(batches):
        table, powers = space_table(), Powers()

        def solve(held: list[tuple]) -> pa.RecordBatch:
            words = Words([h[3] for h in held], table, powers)
            runs = [words.hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
            index = FmIndex(runs, np.array([h[2] for h in held], np.int64), window)
            out = []
            for row, flags in zip(held, index.repeated()):
                edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
                if len(edge):
                    out.append((row[0], row[1], edge[0::2].tolist(), edge[1::2].tolist()))
            columns = list(zip(*out)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:2]], *[pa.array(c, pa.list_(pa.int32())) for c in columns[2:]]],
                ["key", "content", "starts", "ends"])

        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("key", "content", "n", "words")]):
                if row[0] != key and size >= SHARD_WORDS:
                    yield solve(held)
                    held, size = [], 0
                key = row[0]
                held.append(row)
                size += len(row[3]) // 6 + 1
        if held:
            yield solve(held)

    dealt = spelled.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key bigint, content bigint, starts array<int>, ends array<int>")


def _without(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            docs, texts, lists = (batch.column(n).to_pylist() for n in ("doc_id", "text", "covered"))
            out = []
            for doc, text, covered in zip(docs, texts, lists):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at exactly these white spaces
                if covered:
                    edges = np.zeros(len(words) + 1, np.int32)
                    for span in covered:
                        edges[span["from"]] += 1
                        edges[span["to"]] -= 1
                    kept = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                else:
                    kept = words
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")))
            columns = list(zip(*out)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def remove_repeats(spark: SparkSession, documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_removed, kept_sha256, kept (the words left).

    Null and empty texts have no words. Repeated rows are repeats of each other. Null ids stay null. Other
    columns are ignored.
    """
    rows = _rows(documents)
    heavy = _heavy(rows, window, gram)
    segments = materialise(_segments(rows, heavy, window, gram), "segments")
    # written, so that the join reads two plain shuffles and a key with a third of the segments can be split
    several = materialise(segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    shared = materialise(segments.join(several, "key", "left_semi"), "shared")
    distinct = shared.groupBy("key", "content").agg(
        F.min(F.struct("doc", "mark", "first", "windows")).alias("one"), F.count("*").alias("n"))
    wanted = distinct.select("key", "content", "n", "one.doc", "one.mark", "one.first", (F.col("one.windows") + window - 1).alias("words"))
    found = materialise(_stretches(_spelled(rows.select("doc", "mark", "text"), wanted), window), "stretches")

    spans = F.transform(F.arrays_zip("starts", "ends"), lambda run: F.struct(
        (F.col("first") + run["starts"]).alias("from"), (F.col("first") + run["ends"] + window - 1).alias("to")))
    covered = (shared.join(found, ["key", "content"]).select("doc", "mark", F.explode(spans).alias("span"))
               .groupBy("doc", "mark").agg(F.collect_set("span").alias("covered")))
    return _without(rows.join(covered.hint("merge"), ["doc", "mark"], "left").select("doc_id", "text", "covered"), window)
