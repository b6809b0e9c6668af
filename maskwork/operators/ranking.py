"""Positions, running sums and previous values per key, safe for hot keys.

A plain window over a key sorts all its rows in one task.  Here each key is cut into
slices that follow the order (a time bucket, a block of message numbers): rows are ranked
inside their slice, slice totals are summed up first, and the two are added.  Work per
task is bounded by a slice however many rows one key has.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the keys come from the left side."""
    other = right.select(*[F.col(c).alias(f"__right_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"__right_{k}" for k in keys])


def _totals_before(totals: DataFrame, keys: Sequence[str], slice_: str, coarse: Column, value: str) -> DataFrame:
    """Sum of ``value`` over earlier slices of the key, in two levels (coarse group, slice)."""
    grouped = totals.withColumn("__coarse", coarse)
    tops = grouped.groupBy(*keys, "__coarse").agg(F.sum(value).alias("__top"))
    above = Window.partitionBy(*keys).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__above", F.coalesce(F.sum("__top").over(above), F.lit(0))).drop("__top")
    inside = Window.partitionBy(*keys, "__coarse").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("__within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = join_null_safe(within, tops, [*keys, "__coarse"])
    return joined.select(*keys, slice_, (F.col("__above") + F.col("__within")).alias("__before"))


def sliced_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    slice_: Column,
    fanout: int = 1024,
    out: str = "rank",
) -> DataFrame:
    """1-based position of each row within its key. ``slice_`` must be an integer that
    never decreases along ``order``. NULL keys are a key, and NULL order values come first."""
    sliced = df.withColumn("__slice", slice_.cast("bigint"))
    totals = sliced.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = _totals_before(totals, keys, "__slice", F.floor(F.col("__slice") / fanout), "__n")
    w = Window.partitionBy(*keys, "__slice").orderBy(*order)
    ranked = sliced.withColumn("__local", F.row_number().over(w))
    return (
        join_null_safe(ranked, before, [*keys, "__slice"])
        .withColumn(out, (F.col("__before") + F.col("__local")).cast("bigint"))
        .drop("__slice", "__local", "__before")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], at: str, value: str, fanout: int = 1024, out: str = "running"
) -> DataFrame:
    """Running total per key over integer buckets ``at``; the rows are summed per bucket first."""
    totals = df.groupBy(*keys, at).agg(F.sum(value).alias(value))
    before = _totals_before(totals, keys, at, F.floor(F.col(at) / fanout), value)
    return join_null_safe(totals, before, [*keys, at]).select(*keys, at, (F.col("__before") + F.col(value)).alias(out))


def sliced_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    slice_: Column,
    out: str = "previous",
) -> DataFrame:
    """``value`` of the row before in the key's order, NULL for the first row."""
    sliced = df.withColumn("__slice", slice_.cast("bigint"))
    last = sliced.groupBy(*keys, "__slice").agg(
        F.max(F.struct(*[F.col(o) for o in order], F.col(value).alias("__v"))).alias("__last")
    )
    by_slice = Window.partitionBy(*keys).orderBy("__slice")
    carried = last.select(*keys, "__slice", F.lag("__last").over(by_slice)["__v"].alias("__carry"))
    w = Window.partitionBy(*keys, "__slice").orderBy(*order)
    marked = sliced.withColumn("__lag", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return (
        join_null_safe(marked, carried, [*keys, "__slice"])
        .withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag")))
        .drop("__slice", "__lag", "__first", "__carry")
    )
