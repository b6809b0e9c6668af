"""Stateful stream operators, one small state per key.

Rows of a key are taken in event-time order within a micro-batch; across batches they count
in order of arrival.  Bound a batch with the source's files-per-trigger option.  State lives
in the RocksDB store, so it may outgrow memory.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwork.operators.limits import _NONE, bucket_fold, bucket_units, storm_emits
from maskwork.operators.ordering import DAY_US


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["us", "tie"], ignore_index=True)


def _narrow(stream: DataFrame, key: str, us: str, tie: str, *extra: str) -> DataFrame:
    return stream.select(F.col(key).alias("k"), F.col(us).alias("us"), F.col(tie).alias("tie"), *extra)


def _types(df: DataFrame) -> tuple[str, str]:
    types = dict(df.dtypes)
    return types["k"], types["tie"]


def _run(stream: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "None") -> DataFrame:
    return stream.groupBy("k").transformWithStateInPandas(processor, schema, "Append", mode)


def move_timer(handle: StatefulProcessorHandle, before: int | None, due: int) -> None:
    """A timer that is deleted and set for the same time in one batch would be lost."""
    if before != due:
        if before is not None:
            handle.deleteTimer(before)
        handle.registerTimer(due)


class _Bucket(StatefulProcessor):
    """Buckets of the keys of one group: one call and one timer serve many keys."""

    def __init__(self, rate: float, burst: float, idle_ms: int | None, key: str):
        self.scale, self.unit, self.capacity = bucket_units(rate, burst)
        self.idle_ms, self.key = idle_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("buckets", f"k {self.key}, full_us bigint, part bigint, last_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows)
        held = {k: old for k, *old in self.state.get()} if self.state.exists() else {}
        before = max(old[2] for old in held.values()) + self.idle_ms if held and self.idle_ms is not None else None
        us = pdf["us"].to_numpy(np.int64)
        allowed, missing = np.zeros(len(us), dtype=bool), np.zeros(len(us), dtype=np.int64)
        for k, at in pdf.groupby("k", sort=False, dropna=False).indices.items():
            k = None if pd.isna(k) else k.item() if hasattr(k, "item") else k
            old = held.get(k)
            # Times count from the batch's first event of the key; between batches the state is a whole number of
            # microseconds and a rest, so nothing grows beyond 64 bits.
            base = int(us[at[0]])
            full_at = max((old[0] - base) * self.scale + old[1], _NONE) if old else _NONE
            allowed[at], missing[at], full_at = bucket_fold((us[at] - base) * self.scale, full_at, self.unit, self.capacity)
            whole, part = divmod(int(full_at), self.scale)
            held[k] = (base + whole, part, max(int(us[at[-1]]) // 1000, old[2] if old else 0))
        if self.idle_ms is not None:
            due = max(old[2] for old in held.values()) + self.idle_ms
            now = timerValues.getCurrentWatermarkInMs()
            held = {k: old for k, old in held.items() if old[2] + self.idle_ms > now}
            move_timer(self.handle, before, due)
        if held:
            self.state.put([(k, *old) for k, old in held.items()])
        else:
            self.state.clear()
        yield pd.DataFrame({
            "k": pdf["k"], "us": pdf["us"], "tie": pdf["tie"], "allowed": allowed,
            "retry_after": missing / (self.scale * 1_000_000.0),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the timer is that of the group's newest event
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def token_bucket_stream(
    stream: DataFrame, key: str, us: str, tie: str, rate: float = 100.0, burst: float = 0.0,
    event_time: str | None = None, max_idle_ms: int | None = None, groups: int = 4096,
) -> DataFrame:
    """Streaming form of ``token_bucket``. Keys are dealt to ``groups`` by their hash, the state of a group is a list of its keys.

    With ``event_time`` (a watermarked column) and ``max_idle_ms``, buckets idle for longer
    are dropped.  A bucket idle for burst/rate is full anyway, so a limit of at least that
    changes no answer.
    """
    idle_ms = max_idle_ms
    extra = [event_time] if event_time else []
    rows = _narrow(stream, key, us, tie, *extra)
    k, t = _types(rows)
    # missing keys are a group of their own
    rows = rows.withColumn("g", F.when(F.col("k").isNull(), -1).otherwise(F.pmod(F.xxhash64("k"), F.lit(groups))))
    schema = f"k {k}, us bigint, tie {t}, allowed boolean, retry_after double"
    mode = "EventTime" if event_time and idle_ms is not None else "None"
    processor = _Bucket(rate, burst, idle_ms if mode == "EventTime" else None, k)
    out = rows.groupBy("g").transformWithStateInPandas(processor, schema, "Append", mode)
    return out.withColumnsRenamed({"k": key, "us": us, "tie": tie})


class _Storm(StatefulProcessor):
    def __init__(self, window_us: int, tie: str, idle_ms: int | None):
        self.window_us, self.tie, self.idle_ms = window_us, tie, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("storm", "last_emit bigint, pending bigint")
        self.newest = handle.getValueState("newest", f"us bigint, tie {self.tie}")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows)
        last, pending = self.state.get() if self.state.exists() else (_NONE, 0)
        t = pdf["us"].to_numpy(np.int64)
        at = list(storm_emits(t, int(last), self.window_us))
        # Ranks continue where the last emit left off.
        ranks = np.asarray(at, dtype=np.int64) + 1 + pending
        counts = np.diff(np.concatenate(([0], ranks)))
        if at:
            self.state.update((int(t[at[-1]]), int(len(t) - 1 - at[-1])))
        else:
            self.state.update((int(last), int(pending + len(t))))
        if self.idle_ms is not None:
            before = int(self.newest.get()[0]) // 1000 + self.idle_ms if self.newest.exists() else None
            end = pdf.iloc[-1]
            self.newest.update((int(end["us"]), end["tie"].item() if hasattr(end["tie"], "item") else end["tie"]))
            move_timer(self.handle, before, int(end["us"]) // 1000 + self.idle_ms)
        out = pdf.iloc[at][["k", "us", "tie"]].copy()
        out["count"] = counts
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        pending = self.state.get()[1]
        us, tie = self.newest.get()
        self.state.clear()
        self.newest.clear()
        if pending:
            yield pd.DataFrame({"k": [key[0]], "us": [us], "tie": [tie], "count": [pending]}, dtype=object)

    def close(self) -> None:
        pass


def fold_storms_stream(
    stream: DataFrame, key: str, us: str, tie: str, window_us: int = 10_000_000, event_time: str | None = None,
    max_idle_ms: int | None = None,
) -> DataFrame:
    """Streaming form of ``fold_storms``.

    With ``event_time`` (a watermarked column) and ``max_idle_ms``, at least the window, a key that has been idle for
    that long leaves the state. What it had folded and not yet reported comes out then, as one row at its last event;
    without them it waits for the key's next event, as in the batch form.
    """
    idle_ms = max_idle_ms if event_time else None
    if idle_ms is not None and idle_ms * 1000 < window_us:
        raise ValueError("max_idle_ms is shorter than the window")
    rows = _narrow(stream, key, us, tie, *([event_time] if event_time else []))
    k, t = _types(rows)
    out = _run(rows, _Storm(window_us, t, idle_ms), f"k {k}, us bigint, tie {t}, count bigint", "None" if idle_ms is None else "EventTime")
    return out.withColumnsRenamed({"k": key, "us": us, "tie": tie})


class _Budget(StatefulProcessor):
    def __init__(self, expire: bool):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows)
        fresh = not self.used.exists()
        used = 0 if fresh else self.used.get()[0]
        limit = int(pdf["daily_limit"].iloc[0])
        rank = used + 1 + np.arange(len(pdf))
        allowed = np.ones(len(pdf), dtype=bool) if limit <= 0 else rank <= limit
        self.used.update((int(used + allowed.sum()),))
        if fresh and self.expire:
            # The counter goes when the watermark passes the end of its day.
            self.handle.registerTimer((int(pdf["us"].iloc[0]) // DAY_US + 1) * DAY_US // 1000)
        yield pd.DataFrame({"ref": pdf["ref"], "us": pdf["us"], "tie": pdf["tie"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def daily_budget_stream(
    stream: DataFrame, limits: DataFrame, ref: str, us: str, tie: str, event_time: str | None = None
) -> DataFrame:
    """Streaming form of ``daily_budget``: state per reference and UTC day.

    Rows with an empty reference pass without state.  The limit table is joined statically.
    With ``event_time`` (a watermarked column) the counters of finished days are dropped.
    """
    bound = limits.select(F.col(ref).alias("ref"), F.col("daily_requests").alias("daily_limit"))
    extra = [event_time] if event_time else []
    rows = stream.select(
        F.coalesce(F.col(ref), F.lit("")).alias("ref"), F.col(us).alias("us"), F.col(tie).alias("tie"), *extra
    )
    joined = rows.join(bound, "ref", "left").withColumn("daily_limit", F.coalesce("daily_limit", F.lit(0)))
    free = joined.filter(F.col("ref") == "").select("ref", "us", "tie", F.lit(True).alias("allowed"))
    keyed = joined.filter(F.col("ref") != "").withColumn(
        "k", F.concat_ws("|", "ref", F.floor(F.col("us") / DAY_US).cast("string"))
    )
    tie_type = dict(rows.dtypes)["tie"]
    mode = "EventTime" if event_time else "None"
    out = _run(keyed, _Budget(bool(event_time)), f"ref string, us bigint, tie {tie_type}, allowed boolean", mode)
    return out.unionByName(free).withColumnsRenamed({"ref": ref, "us": us, "tie": tie})


class _OptOut(StatefulProcessor):
    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.granted = handle.getValueState("granted", "us bigint")

    def handleInputRows(self, key, rows, timerValues):
        # At equal times a grant counts before a request.
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values(["us", "is_grant", "tie"], ascending=[True, False, True], ignore_index=True)
        last = self.granted.get()[0] if self.granted.exists() else _NONE
        grants = np.where(pdf["is_grant"], pdf["us"], _NONE)
        latest = np.maximum(np.maximum.accumulate(grants), last)
        if latest[-1] != last:
            self.granted.update((int(latest[-1]),))
        flags = (latest != _NONE) & (pdf["us"].to_numpy(np.int64) - latest <= self.ttl_us)
        out = pd.DataFrame({"k": pdf["k"], "us": pdf["us"], "tie": pdf["tie"], "opted_out": flags})
        yield out[~pdf["is_grant"].to_numpy(bool)]

    def close(self) -> None:
        pass


def optout_stream(stream: DataFrame, session: str, us: str, tie: str, is_grant: str, ttl_us: int) -> DataFrame:
    """Streaming form of ``with_optout`` over one stream of grants and requests."""
    rows = _narrow(stream, session, us, tie, F.col(is_grant).alias("is_grant"))
    k, t = _types(rows)
    out = _run(rows, _OptOut(ttl_us), f"k {k}, us bigint, tie {t}, opted_out boolean")
    return out.withColumnsRenamed({"k": session, "us": us, "tie": tie})


class _Cut(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "due_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", ignore_index=True)
        bad = np.flatnonzero(pdf["err"].notna().to_numpy())
        over = self.ended.exists()
        if over and self.idle_ms is not None and int(pdf["ms"].min()) >= self.ended.get()[0]:
            # the rows come after the idle time and before its timer
            self.handle.deleteTimer(self.ended.get()[0])
            self.ended.clear()
            over = False
        if over or len(bad):
            due = 0
            if self.idle_ms is not None:
                before = self.ended.get()[0] if over else None
                due = max(int(pdf["ms"].max()) + self.idle_ms, before or 0)
                move_timer(self.handle, before, due)
            self.ended.update((due,))
        if not over:
            yield pdf.iloc[: bad[0] + 1 if len(bad) else None][["k", "seq", "delta", "err"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.ended.clear()
        return iter(())

    def close(self) -> None:
        pass


def cut_on_error(chunks: DataFrame, stream: str, seq: str, err: str) -> DataFrame:
    """Batch form: chunks of a stream up to and including its first error."""
    ends = chunks.filter(F.col(err).isNotNull()).groupBy(stream).agg(F.min(seq).alias("__end"))
    kept = chunks.join(ends, stream, "left").filter(F.col("__end").isNull() | (F.col(seq) <= F.col("__end")))
    return kept.drop("__end")


def cut_on_error_stream(
    chunks: DataFrame, stream: str, seq: str, delta: str, err: str, event_time: str | None = None, max_idle_ms: int | None = None
) -> DataFrame:
    """Streaming form: after an error chunk the rest of its stream is dropped.

    With ``event_time`` (a watermarked column) and ``max_idle_ms``, the mark of an ended stream goes when no chunk has come
    for that long; a stream of that name that starts later is a new one.
    """
    idle_ms = max_idle_ms if event_time else None
    ms = [F.unix_millis(event_time).alias("ms"), F.col(event_time)] if idle_ms is not None else []
    rows = chunks.select(F.col(stream).alias("k"), F.col(seq).alias("seq"), F.col(delta).alias("delta"), F.col(err).alias("err"), *ms)
    k = dict(rows.dtypes)["k"]
    seq_type = dict(rows.dtypes)["seq"]
    out = _run(rows, _Cut(idle_ms), f"k {k}, seq {seq_type}, delta string, err string", "None" if idle_ms is None else "EventTime")
    return out.withColumnsRenamed({"k": stream, "seq": seq, "delta": delta, "err": err})
