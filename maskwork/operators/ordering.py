"""Replays, top lists and ordered assembly."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwork.operators.ranking import running_sum, sliced_previous, sliced_rank

DAY_US = 86_400_000_000


def daily_budget(
    events: DataFrame, limits: DataFrame, ref: str, us: str, tie: str, slice_us: int = 60_000_000
) -> DataFrame:
    """Add ``allowed``: a request passes while fewer than the limit passed before it that UTC day.

    Refusals never free capacity, so the position in the day decides.  An empty reference is
    allowed and not counted; a missing or non-positive limit is unlimited.
    """
    named = events.withColumn("__day", F.floor(F.col(us) / DAY_US))
    counted = named.filter(F.coalesce(F.col(ref), F.lit("")) != "")
    free = named.filter(F.coalesce(F.col(ref), F.lit("")) == "")
    ranked = sliced_rank(
        counted, [ref, "__day"], [us, tie], F.floor((F.col(us) % DAY_US) / slice_us), out="__rank"
    )
    bounded = limits.select(F.col(ref), F.col("daily_requests").alias("__limit"))
    limit = F.coalesce("__limit", F.lit(0))
    decided = ranked.join(bounded, ref, "left").withColumn("allowed", (limit <= 0) | (F.col("__rank") <= limit))
    return decided.drop("__rank", "__limit", "__day").unionByName(
        free.withColumn("allowed", F.lit(True)).drop("__day")
    )


def budget_remaining(events: DataFrame, limits: DataFrame, ref: str, us: str, day: int) -> DataFrame:
    """ref, remaining for one UTC day; -1 where there is no limit, never below 0."""
    used = (
        events.filter(F.floor(F.col(us) / DAY_US) == day)
        .groupBy(ref).agg(F.count("*").alias("used"))
    )
    lim = F.col("daily_requests")
    left = F.greatest(lim - F.coalesce("used", F.lit(0)), F.lit(0))
    return limits.join(used, ref, "left").select(
        ref, F.when(lim <= 0, F.lit(-1.0)).otherwise(left.cast("double")).alias("remaining")
    )


def recent(df: DataFrame, ts: str, tie: str, n: int | None = 20, capacity: int | None = None) -> DataFrame:
    """Newest n rows, newest first. n out of range means the whole capacity, which is all rows unless given."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie).desc())
    wanted = [x for x in (n, capacity) if x is not None and x > 0]
    return ordered.limit(min(wanted)) if wanted else ordered


def last_user_turn(parts: DataFrame, request: str, msg: str, role: str, text: str) -> DataFrame:
    """Newest user message of each request: (request, msg, text)."""
    users = parts.filter(F.col(role) == "user")
    return users.groupBy(request).agg(F.max(msg).alias(msg), F.max_by(text, msg).alias(text))


def assemble_text(
    df: DataFrame, key: str, seq: str, text: str, sep: str = "", block: int | None = None
) -> DataFrame:
    """Texts joined in order as (key, block, text): one row per key, with block 0.

    The row holds the key's whole text. With ``block``, a key gives one row per so many sequence
    numbers instead, for keys whose text is too long for one row.
    """
    number = F.floor(F.col(seq) / block) if block else F.lit(0)
    blocks = df.withColumn("block", number.cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return blocks.groupBy(key, "block").agg(
        F.array_join(F.transform(ordered, lambda x: F.coalesce(x["t"], F.lit(""))), sep).alias(text)
    )


def hoist_system(parts: DataFrame, request: str, msg: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """System turns joined with newlines, and the other messages with roles user or assistant."""
    system = assemble_text(parts.filter(F.col(role) == "system"), request, msg, text, "\n")
    rest = parts.filter(F.col(role) != "system").withColumn(
        role, F.when(F.col(role) == "assistant", "assistant").otherwise("user")
    )
    return system, rest


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


# Legal steps of the vault life cycle besides "failed".
LEGAL_STEPS = {
    "open": ("streaming", "draining", "closed"),
    "streaming": ("draining", "closed"),
    "draining": ("closed",),
    "failed": ("closed",),
}


def legal_step(previous: Column, state: Column) -> Column:
    ok = F.lit(False)
    for start, ends in LEGAL_STEPS.items():
        ok = ok | ((previous == start) & state.isin(*ends))
    return F.when(state == "failed", previous != "closed").otherwise(ok)


def lifecycle_check(
    events: DataFrame, session: str, us: str, tie: str, state: str, slice_us: int = 3_600_000_000
) -> DataFrame:
    """Add ``previous`` and ``legal`` for each step of a session; the first step has no previous."""
    stepped = sliced_previous(events, [session], [us, tie], state, F.floor(F.col(us) / slice_us))
    first = F.col("previous").isNull()
    return stepped.withColumn("legal", first | legal_step(F.col("previous"), F.col(state)))


def active_sessions(events: DataFrame, us: str, delta: Column, minute_us: int = 60_000_000) -> DataFrame:
    """minute, active: sessions opened minus closed up to the end of each minute."""
    per_minute = events.select(F.floor(F.col(us) / minute_us).cast("bigint").alias("minute"), delta.alias("d"))
    return running_sum(per_minute, [], "minute", "d", out="active")


def keep_newest(df: DataFrame, group: Sequence[str], name: str, keep: int) -> DataFrame:
    """Newest ``keep`` names per group, at least one. Spark cuts each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.col(name).desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max(keep, 1)).drop("__rn")


def tail_lines(logs: DataFrame, ts: str, tie: str, n: int | None = 200) -> DataFrame:
    """Newest log lines, 200 unless another number is given; all if it is None or not positive."""
    return recent(logs, ts, tie, n)
