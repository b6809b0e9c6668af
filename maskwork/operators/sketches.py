"""Series counts and latency quantiles as mergeable sketches, one small table a day.

A day's rows are scanned once into one HyperLogLog sketch per metric or one KLL sketch per payload class. Any window of
days is a merge of sketches: no row is read again, nothing is sorted, and a day that is scanned anew replaces its own
sketches only. Errors: the count is off by 1.04 / sqrt(2^lg_k) (0.8 % by default) at one standard deviation, the rank of a
quantile by about 0.4 %.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
KLL_K = 800
DAY_US = 86_400_000_000


def _day(us: str) -> Column:
    return F.floor(F.col(us) / DAY_US).cast("bigint").alias("day")


def series_sketches(samples: DataFrame, metric: str, us: str, labels: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """metric, day, samples, sketch: the label combinations of each metric and day. The metric is part of a series' name,
    so that sketches of several metrics add up."""
    name = F.to_json(F.struct(metric, *labels), {"ignoreNullFields": "false"})
    return samples.groupBy(metric, _day(us)).agg(F.count("*").alias("samples"), F.hll_sketch_agg(name, F.lit(lg_k)).alias("sketch"))


def latency_sketches(requests: DataFrame, dims: Sequence[str], us: str, ms: str, k: int = KLL_K) -> DataFrame:
    """dims, day, requests, sketch: the distribution of whole milliseconds; rows without a time are not counted."""
    timed = requests.where(F.col(ms).isNotNull())
    return timed.groupBy(*dims, _day(us)).agg(
        F.count("*").alias("requests"), F.kll_sketch_agg_bigint(F.col(ms).cast("bigint"), F.lit(k)).alias("sketch"))


def write_days(sketches: DataFrame, path: str) -> None:
    """Store sketches by day; days that are there already are replaced, others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def over_days(sketches: DataFrame, dims: Sequence[str], days: int) -> DataFrame:
    """Every row once for each day whose window of ``days`` days holds it; only days with a sketch of their own count."""
    ends = sketches.select(*dims, "day").distinct()
    spread = sketches.withColumn("day", F.explode(F.sequence(F.col("day"), F.col("day") + (days - 1))))
    return spread.join(ends, [*dims, "day"], "left_semi")


def rolling_series(sketches: DataFrame, dims: Sequence[str], days: int = 30, warn: int = 40_000, refuse: int = 50_000) -> DataFrame:
    """dims, day, series, state: estimated series of the window that ends with the day. Without ``dims``, of all metrics together."""
    merged = over_days(sketches, dims, days).groupBy(*dims, "day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("series"))
    n = F.col("series")
    return merged.withColumn("state", F.when(n >= refuse, "refuse").when(n >= warn, "warn").otherwise("ok"))


def rolling_latency(sketches: DataFrame, dims: Sequence[str], days: int = 30, quantiles: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """dims, day, requests and one column per quantile (p95, p99) of the window that ends with the day."""
    merged = over_days(sketches, dims, days).groupBy(*dims, "day").agg(
        F.sum("requests").alias("requests"), F.kll_merge_agg_bigint("sketch").alias("__all"))
    picks = [F.kll_sketch_get_quantile_bigint("__all", F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles]
    return merged.select(*dims, "day", "requests", *picks)
