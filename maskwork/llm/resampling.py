"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs are hashed into buckets. One pass counts every bucket over all documents (raw) and over
the labelled good ones (target). A document's log weight is the sum over its n-grams of the log
ratio of the smoothed shares. Adding Gumbel noise, drawn from a hash of the id, and keeping the k
largest keys samples k documents without replacement in proportion to their weights. The k-th
key is found by counting keys in ever finer bins, so only bin counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.llm.words import Powers, Words, chunks, plain_table
from maskwork.session import materialise

BITS = 16
BINS = 4096


def gram_buckets(texts: list, table: np.ndarray, powers: Powers, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each word and each pair of words."""
    words = Words(texts, table, powers)
    owner, shift = words.owner, np.uint64(64 - bits)
    pairs = words.hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + words.hashes[1:]
    inside = owner[:-1] == owner[1:]
    buckets = np.concatenate([words.hashes >> shift, ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> shift)[inside]])
    return buckets.astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def gram_counts(documents: DataFrame, good: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all rows of ``documents`` and over those whose id is in ``good``."""
    marked = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    marked = marked.join(good.hint("merge"), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches):
        table, powers = plain_table(), Powers()
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts, marks = batch.column("text").to_pylist(), batch.column("good").to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                buckets, owner = gram_buckets(texts[a:b], table, powers, bits)
                raw += np.bincount(buckets, minlength=1 << bits)
                target += np.bincount(buckets[marks[a:b][owner]], minlength=1 << bits)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counted = marked.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most 2 ** bits rows
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    at = counted.column("bucket").to_numpy()
    raw[at], target[at] = counted.column("raw").to_numpy(), counted.column("target").to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target share over raw share. The target is smoothed by one raw-distributed n-gram per bucket,
    so that a bucket it hardly holds says little."""
    shares = (raw + 1) / (raw.sum() + len(raw))
    prior = float(len(raw))
    return np.log((target + prior * shares) / (target.sum() + prior)) - np.log(shares)


def weigh(spark: SparkSession, documents: DataFrame, ratios: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id, log_weight and draw (a hash for the noise) of every row."""
    shared = spark.sparkContext.broadcast(ratios)  # 2 ** bits numbers

    def run(batches):
        table, powers = plain_table(), Powers()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [np.zeros(0)]
            for a, b in chunks(texts):
                buckets, owner = gram_buckets(texts[a:b], table, powers, bits)
                parts.append(np.bincount(owner, shared.value[buckets], minlength=b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("draw"), pa.array(np.concatenate(parts))],
                                             ["doc_id", "draw", "log_weight"])

    text = F.col("text").cast("string")
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                              F.coalesce(F.xxhash64("doc_id", F.lit("gumbel")), F.xxhash64(text)).alias("draw"))
    return narrow.mapInArrow(run, "doc_id bigint, draw bigint, log_weight double")


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly; None if k is 0 or there are fewer rows."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or n < k:
        return None
    left = k
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        rows = keys.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(rows, key=lambda r: -r["bin"]):
            if row["n"] >= left:
                low, high = row["low"], row["high"]
                break
            left -= row["n"]
    return low


def gumbel_key(weight: Column, draw: Column) -> Column:
    """Weight plus standard Gumbel noise from 52 bits of a hash."""
    unit = (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(unit))


def resample(spark: SparkSession, documents: DataFrame, labels: DataFrame, share: float | None = None, bits: int = BITS) -> DataFrame:
    """One row per row of ``documents``: doc_id, log_weight, key, kept.

    ``share`` of the rows is kept; by default the share of good ones among the labelled. Without a good label
    all weights are 0 and the sample is even. Null and empty texts weigh 0. Null ids draw their noise
    by their text. Rows that tie with the last kept key are kept too, so equal rows share one fate.
    """
    rated = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (F.max("quality") == 1).alias("good"))
    if share is None:
        share = rated.agg(F.avg(F.col("good").cast("double"))).first()[0]
    raw, target = gram_counts(documents, rated, bits)
    ratios = log_ratios(raw, target) if target.sum() else np.zeros(1 << bits)
    keyed = materialise(weigh(spark, documents, ratios, bits).select(
        "doc_id", "log_weight", gumbel_key(F.col("log_weight"), F.col("draw")).alias("key")), "weights")
    total = keyed.count()
    least = kth_largest(keyed, "key", round(total * (1.0 if share is None else share)))
    return keyed.withColumn("kept", F.col("key") >= F.lit(least) if least is not None else F.lit(False))
