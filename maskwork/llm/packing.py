"""Packing of tokenized documents into sequences, shortest pack first over the length histogram.

Documents are cut into pieces of at most ``width`` tokens. The pieces' lengths form a histogram of
at most ``width`` counts. Lengths are placed longest first; each goes to the open packs with the
most room that it fits, all equal pieces and equal packs in one step, which yields packing patterns
with counts. The n-th piece of a length (its rank, taken in blocks so that no length is
sorted in one task) then finds its sequence and offset among the ranges of the patterns.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwork.llm.bpe import WordBpe
from maskwork.llm.wordcache import CHUNK, WordCache
from maskwork.llm.words import chunks
from maskwork.session import materialise

WIDTH = 4096
END = 2
BLOCK_ROWS = 50_000


def pieces(documents: DataFrame, vocabulary: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; a null text has the end id alone."""

    def run(batches):
        cache = WordCache(WordBpe(vocabulary).encode)
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK):
                ids, bounds = cache.ids_of(texts[a:b])
                rows = []
                for d in range(b - a):
                    own = np.append(ids[bounds[d] : bounds[d + 1]], end).astype("<u4")
                    for at in range(0, len(own), width):
                        part = own[at : at + width]
                        rows.append((docs[a + d], at, len(part), zlib.crc32(part.tobytes()), len(own)))
                columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs for ``histogram`` (length -> pieces)."""
    open_: list[deque] = [deque() for _ in range(width + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed = []
        room = width
        while left and room >= length:
            if not open_[room]:
                room -= 1
                continue
            count, pack = open_[room].pop()
            used = min(count, left)
            if count > used:
                open_[room].append((count - used, pack))
            placed.append((room - length, used, (*pack, length)))
            left -= used
        if left:
            # as many to a new pack as fit: packs of one length alone
            each = width // length
            if left >= each:
                placed.append((width - each * length, left // each, (length,) * each))
            if left % each:
                placed.append((width - (left % each) * length, 1, (length,) * (left % each)))
        for rest, count, pack in placed:
            open_[rest].append((count, pack))
    return [entry for packs in open_ for entry in packs]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted; ranks of a length count from 0."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pack in packs:
        offset = 0
        for length in pack:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _ranked(table: DataFrame, total: int) -> DataFrame:
    """``table`` with the 0-based rank of each piece among those of its length."""
    blocks = max(1, -(-total // BLOCK_ROWS))
    cut = table.withColumn("__block", F.pmod("__salt", F.lit(blocks))).drop("__salt")
    counts = cut.groupBy("length", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__block").orderBy("doc_id", "start", "ids_crc32")
    return (cut.withColumn("__in", F.row_number().over(inside)).join(counts, ["length", "__block"])
            .withColumn("rank", F.col("__before") + F.col("__in") - 1).drop("__block", "__in", "__before"))


def pack(spark: SparkSession, documents: DataFrame, vocabulary: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """One row per piece with its sequence_id and offset; every id lies in one piece.

    Null and empty texts are the end id alone; null ids stay null; repeated rows are packed once each;
    an empty table gives no rows. Only ``doc_id`` and ``text`` are read. The driver sees the histogram
    (at most ``width`` counts), and the tasks the patterns' ranges, whose number is bounded by it.
    """
    # a written random number, not a hash of the id, deals rows to blocks: null and repeated ids spread like all others
    table = materialise(pieces(documents, vocabulary, width, end).withColumn("__salt", F.floor(F.rand(7) * (1 << 30)).cast("int")), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(patterns(histogram, width)))

    def place(batches):
        rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            found = [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])]
            columns = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, *found], [
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return _ranked(table, sum(histogram.values())).mapInArrow(
        place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
