"""Rate limiting and storm folding over event logs.

Both are folds: what happens to an event depends on all earlier events of its key.  Keys
are cut into runs of bounded length by rank.  Each later run is first summarised as a
function from the state on entry to the state on exit; chaining the few summaries of a key
gives every run its true entry state, and the runs are then folded side by side.  The
result equals the plain fold, and no task ever holds more than one run of a hot key.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.operators.ranking import join_null_safe, sliced_previous, sliced_rank
from maskwork.session import materialise

RUN_ROWS = 500_000
_NONE = -(1 << 62)  # state before the first event of a key


def _in_runs(events: DataFrame, key: str, us: str, tie: str, run_rows: int, slice_us: int) -> DataFrame:
    """k, us, tie, r, run: the key's events numbered in order and cut into runs."""
    narrow = events.select(F.col(key).alias("k"), F.col(us).alias("us"), F.col(tie).alias("tie"))
    ranked = sliced_rank(narrow, ["k"], ["us", "tie"], F.floor(F.col("us") / slice_us), out="r")
    runs = ranked.withColumn("run", F.floor((F.col("r") - 1) / run_rows).cast("bigint"))
    # Ranked once and kept: the summaries and the fold both read it.
    return materialise(runs, "runs")


def _key_type(df: DataFrame) -> str:
    return dict(df.dtypes)["k"]


def _with_entry(runs: DataFrame, summary) -> DataFrame:
    """Runs with the entry state of every later run as one more row, which sorts first in its run.

    ``summary`` gives the pieces (upto, shift, fixed) of a run from its times. The states come in by union and not by a
    join: the folds below rely on a run being whole in one task, and a join before them lets adaptive execution drop
    their repartitioning and split a skewed run over tasks. Summaries and chains pass many runs and keys per Arrow batch,
    so short runs cost no call of their own.
    """
    plain = runs.withColumn("entry", F.lit(_NONE).cast("bigint"))
    types = dict(runs.dtypes)
    last = runs.groupBy("k").agg(F.max("run").alias("__last")).filter(F.col("__last") > 0)
    long = join_null_safe(runs, last, ["k"]).filter(F.col("run") < F.col("__last")).drop("__last")
    maps = _in_order(long.withColumn("entry", F.lit(_NONE).cast("bigint"))).mapInPandas(
        _summaries(summary), f"k {types['k']}, run bigint, upto array<bigint>, shift array<bigint>, fixed array<boolean>"
    )
    entries = maps.repartition("k").sortWithinPartitions("k", "run").mapInPandas(_chain, f"k {types['k']}, run bigint, entry bigint")
    marks = entries.select(
        "k", F.lit(_NONE).cast("bigint").alias("us"), F.lit(0).cast(types["tie"]).alias("tie"),
        F.lit(0).cast("bigint").alias("r"), "run", "entry",
    )
    return plain.unionByName(marks)


def _summaries(summary):
    """Summaries of runs that come in order; of a run that goes on in the next batch only the times are kept."""

    def closed(runs: list) -> pd.DataFrame:
        rows = [(k, run, *summary(np.concatenate(times))) for (k, run), times in runs]
        return pd.DataFrame(rows, columns=["k", "run", "upto", "shift", "fixed"], dtype=object)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, times = None, []
        for pdf in batches:
            us, done = pdf["us"].to_numpy(np.int64), []
            for lo, hi, run, _ in _stretches(pdf):
                if run != here:
                    if here is not None:
                        done.append((here, times))
                    here, times = run, []
                times.append(us[lo:hi])
            if done:
                yield closed(done)
        if here is not None:
            yield closed([(here, times)])

    return summarise


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry states of the runs 1.. of each key from the summaries of the runs before them."""
    here, state = None, _NONE
    for pdf in batches:
        rows = []
        for k, run, upto, shift, fixed in zip(_keys(pdf["k"]), *[pdf[c].tolist() for c in ("run", "upto", "shift", "fixed")]):
            if (k,) != here:
                here, state = (k,), _NONE
            i = int(np.searchsorted(np.asarray(upto), state, side="left"))
            state = int(shift[i]) if fixed[i] else state + int(shift[i])
            rows.append((k, run + 1, state))
        yield pd.DataFrame(rows, columns=["k", "run", "entry"], dtype=object)


_MAX = (1 << 62)


def _in_order(runs: DataFrame) -> DataFrame:
    """Runs spread over tasks, each run whole and in event order within its task."""
    return runs.repartition("k", "run").sortWithinPartitions("k", "run", "us", "tie")


def _keys(k: pd.Series) -> list:
    """The keys with None for a missing one, so that missing keys are equal."""
    return k.astype(object).where(k.notna(), None).tolist()


def _stretches(pdf: pd.DataFrame) -> Iterator[tuple[int, int, tuple, int]]:
    """(from, to, run, entry state) of the stretches of one run within an Arrow batch.

    A run may go on in the next batch, so the fold keeps its state between batches and holds
    one batch in memory at a time.  The row that brings the entry state is not in the stretch.
    """
    if not len(pdf):
        return
    k, none, run = pdf["k"].to_numpy(), pdf["k"].isna().to_numpy(), pdf["run"].to_numpy()
    us, entry = pdf["us"].to_numpy(np.int64), pdf["entry"].to_numpy(np.int64)
    other = (k[1:] != k[:-1]) & ~(none[1:] & none[:-1])
    starts = np.concatenate(([0], np.flatnonzero(other | (run[1:] != run[:-1])) + 1))
    keys = _keys(pdf["k"].iloc[starts])
    for lo, hi, key in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], keys):
        yield lo + int(us[lo] == _NONE), hi, (key, int(run[lo])), int(entry[lo])


# --- token bucket -------------------------------------------------------------------------


def bucket_units(rate: float, burst: float) -> tuple[int, int, int]:
    """(scale, unit, capacity): times count in microseconds * scale, one token is ``unit``.

    All three are integers, so the fold is exact.
    """
    r, b = Fraction(str(rate)), Fraction(str(burst))
    if r <= 0:
        r = Fraction(100)
    if b <= 0:
        b = r
    scale = r.numerator * b.denominator
    unit = 1_000_000 * r.denominator * b.denominator
    capacity = int(unit * b)
    shared = gcd(gcd(scale, unit), capacity)
    return scale // shared, unit // shared, capacity // shared


def bucket_fold(v: np.ndarray, full_at: int, unit: int, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Allowed flags, missing amount for refusals, and the time at which the bucket is full.

    The whole state is ``full_at``: the bucket lacks max(0, full_at - now).
    """
    room = capacity - unit
    allowed = np.zeros(len(v), dtype=bool)
    missing = np.zeros(len(v), dtype=np.int64)
    for i, now in enumerate(v.tolist()):
        lacks = full_at - now
        if lacks < 0:
            lacks = 0
        if lacks <= room:
            allowed[i] = True
            full_at = now + lacks + unit
        else:
            missing[i] = lacks - room
    return allowed, missing, full_at


def bucket_summary(v: np.ndarray, unit: int, capacity: int) -> tuple[list[int], list[int], list[bool]]:
    """Exit state as a function of the entry state, in pieces up to ``upto``: fixed or shifted."""
    # After a gap of a whole capacity the bucket is full whatever happened before.
    gaps = np.flatnonzero(np.diff(v) >= capacity)
    if len(gaps):
        *_, end = bucket_fold(v[gaps[-1] + 1:], _NONE, unit, capacity)
        return [_MAX], [end], [True]
    room = capacity - unit
    hi = np.array([_MAX], dtype=np.int64)  # pieces by entry state: up to hi
    add = np.array([0], dtype=np.int64)
    const = np.array([False])
    for now in v.tolist():
        cuts = np.array([now, now + room], dtype=np.int64)
        lo = np.concatenate(([_NONE - 1], hi[:-1]))
        for cut in cuts:
            # Entry states whose image crosses the cut are split there.
            at = cut - add
            inside = ~const & (at > lo) & (at < hi)
            if inside.any():
                idx = np.flatnonzero(inside)
                hi = np.insert(hi, idx, at[idx])
                add = np.insert(add, idx, add[idx])
                const = np.insert(const, idx, const[idx])
                lo = np.concatenate(([_NONE - 1], hi[:-1]))
        top = np.where(const, add, hi + add)
        full = top <= now
        allowed = ~full & (top <= now + room)
        add = np.where(full, (now + unit) if room >= 0 else add, np.where(allowed, add + unit, add))
        if room >= 0:
            const = const | full
        same = (add[1:] == add[:-1]) & (const[1:] == const[:-1])
        keep = np.concatenate((~same, [True]))
        hi, add, const = hi[keep], add[keep], const[keep]
    return hi.tolist(), add.tolist(), const.tolist()


def token_bucket(
    events: DataFrame,
    key: str,
    us: str,
    tie: str,
    rate: float = 100.0,
    burst: float = 0.0,
    run_rows: int = RUN_ROWS,
    slice_us: int = 60_000_000,
) -> DataFrame:
    """key, us, tie, allowed, retry_after (seconds, 0 when allowed)."""
    scale, unit, capacity = bucket_units(rate, burst)
    runs = _in_runs(events, key, us, tie, run_rows, slice_us)
    typ, tie_typ = _key_type(runs), dict(runs.dtypes)["tie"]
    # Times count from the first event, so that they stay small when multiplied.
    base, last = runs.agg(F.min("us"), F.max("us")).first()
    base = base or 0
    if ((last or 0) - base) * scale + capacity >= _MAX // 2:
        raise ValueError("the log is too long for exact counts at this rate; cut it or round the rate")

    def summary(us: np.ndarray) -> tuple[list[int], list[int], list[bool]]:
        return bucket_summary((us - base) * scale, unit, capacity)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, full_at = None, _NONE
        for pdf in batches:
            v = (pdf["us"].where(pdf["us"] != _NONE, base).to_numpy(np.int64) - base) * scale
            allowed, missing = np.zeros(len(v), dtype=bool), np.zeros(len(v), dtype=np.int64)
            for lo, hi, run, entry in _stretches(pdf):
                if run != here:
                    here, full_at = run, entry
                allowed[lo:hi], missing[lo:hi], full_at = bucket_fold(v[lo:hi], full_at, unit, capacity)
            out = pd.DataFrame({
                "k": pdf["k"], "us": pdf["us"], "tie": pdf["tie"], "allowed": allowed,
                "retry_after": missing / (scale * 1_000_000.0),
            })
            yield out[pdf["us"] != _NONE]

    entered = _with_entry(runs, summary)
    out = _in_order(entered).mapInPandas(
        fold, f"k {typ}, us bigint, tie {tie_typ}, allowed boolean, retry_after double"
    )
    return out.select(F.col("k").alias(key), F.col("us").alias(us), F.col("tie").alias(tie), "allowed", "retry_after")


# --- storm folding ------------------------------------------------------------------------


def storm_emits(t: np.ndarray, last: int, window: int) -> Iterator[int]:
    """Positions of the events that emit, given the time of the last emit before them."""
    i = 0 if last == _NONE else int(np.searchsorted(t, last + window, side="left"))
    while i < len(t):
        yield i
        i = max(int(np.searchsorted(t, t[i] + window, side="left")), i + 1)


def storm_summary(t: np.ndarray, window: int) -> tuple[list[int], list[int], list[bool]]:
    """Time of the last emit after the run as a function of the one before it."""
    n = len(t)
    nxt = np.maximum(np.searchsorted(t, t + window, side="left"), np.arange(1, n + 1))
    final = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            final[i] = final[nxt[i]]
    # Entering with e, the first event at or after e + window emits; e is at most t[0].
    reach = min(int(np.searchsorted(t, t[0] + window, side="left")) + 1, n)
    upto, shift, fixed = [], [], []
    for i in range(reach):
        end, bound = int(t[final[i]]), int(t[i]) - window
        if fixed and shift[-1] == end:
            upto[-1] = bound
        elif not upto or bound > upto[-1]:
            upto.append(bound)
            shift.append(end)
            fixed.append(True)
    upto.append(_MAX)
    shift.append(0)
    fixed.append(False)
    return upto, shift, fixed


def fold_storms(
    events: DataFrame,
    key: str,
    us: str,
    tie: str,
    window_us: int = 10_000_000,
    run_rows: int = RUN_ROWS,
    slice_us: int = 60_000_000,
) -> DataFrame:
    """key, us, tie, count of the events that emit a line.

    The first event emits with count 1; after that the first event at least a window after
    the last emit does, counting those folded since.  A trailing remainder is not reported.
    """
    runs = _in_runs(events, key, us, tie, run_rows, slice_us)
    typ, tie_typ = _key_type(runs), dict(runs.dtypes)["tie"]

    def emits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = None, _NONE
        for pdf in batches:
            t, at = pdf["us"].to_numpy(np.int64), []
            for lo, hi, run, entry in _stretches(pdf):
                if run != here:
                    here, last = run, entry
                at += [lo + i for i in storm_emits(t[lo:hi], last, window_us)]
                if at and at[-1] >= lo:
                    last = int(t[at[-1]])
            yield pdf.iloc[at][["k", "us", "tie", "r"]]

    entered = _with_entry(runs, lambda t: storm_summary(t, window_us))
    out = _in_order(entered).mapInPandas(emits, f"k {typ}, us bigint, tie {tie_typ}, r bigint")
    # The count is the distance in rank to the emit before, over all runs of the key.
    counted = sliced_previous(out, ["k"], ["us", "tie"], "r", F.floor(F.col("us") / (slice_us * 60)))
    return counted.select(
        F.col("k").alias(key), F.col("us").alias(us), F.col("tie").alias(tie),
        (F.col("r") - F.coalesce("previous", F.lit(0))).alias("count"),
    )


def storm_lines(folded: DataFrame, count: str = "count", window_us: int = 10_000_000) -> DataFrame:
    """Add ``repeated`` and ``window_sec``, set only where a line stands for several events."""
    many = F.col(count) > 1
    return folded.withColumn("repeated", F.when(many, F.col(count))).withColumn(
        "window_sec", F.when(many, F.lit(window_us // 1_000_000))
    )
