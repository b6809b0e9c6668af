"""Sliced operators against plain Python folds on random and skewed data."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwork.operators import limits as T
from maskwork.operators.ranking import running_sum, sliced_previous, sliced_rank


def events(seed, n=600, keys=4, step=(0, 900_000)):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, rng.randint(*step), rng.randint(0, 50_000)])
        # One key holds most rows.
        rows.append(("hot" if rng.random() < 0.7 else f"k{rng.randrange(keys)}", t, i))
    return rows


def bucket_by_hand(rows, rate, burst):
    state, out = {}, {}
    for key, us, tie in sorted(rows, key=lambda r: (r[1], r[2])):
        unit = 1_000_000
        tokens, last = state.get(key, (burst * unit, us))
        tokens = min(burst * unit, tokens + (us - last) * rate)
        ok = tokens >= unit
        out[(key, tie)] = (ok, 0.0 if ok else (unit - tokens) / (rate * 1e6))
        state[key] = (tokens - unit if ok else tokens, us)
    return out


@pytest.mark.parametrize("seed,rate,burst,run_rows", [(1, 1, 2, 10_000), (2, 1, 2, 7), (3, 3, 5, 25), (4, 2, 1, 3), (5, 10, 40, 50)])
def test_token_bucket(spark, seed, rate, burst, run_rows):
    rows = events(seed)
    df = spark.createDataFrame(rows, "key string, us bigint, tie bigint")
    got = {(r.key, r.tie): (r.allowed, pytest.approx(r.retry_after)) for r in
           T.token_bucket(df, "key", "us", "tie", rate, burst, run_rows=run_rows, slice_us=5_000_000).collect()}
    assert got == bucket_by_hand(rows, rate, burst)


def test_token_bucket_fixture(spark):
    rows = [("a", 0, 0), ("a", 100_000, 1), ("a", 200_000, 2), ("a", 300_000, 3), ("a", 1_500_000, 4)]
    df = spark.createDataFrame(rows, "key string, us bigint, tie bigint")
    got = T.token_bucket(df, "key", "us", "tie", 1, 2).orderBy("tie").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True]


def storms_by_hand(rows, window):
    state, out = {}, {}
    for key, us, tie in sorted(rows, key=lambda r: (r[1], r[2])):
        start, pending = state.get(key, (None, 0))
        pending += 1
        if start is None or us - start >= window:
            out[(key, tie)] = pending
            start, pending = us, 0
        state[key] = (start, pending)
    return out


@pytest.mark.parametrize("seed,window,run_rows", [(1, 10_000_000, 10_000), (2, 10_000_000, 9), (3, 1_000_000, 4), (4, 300_000, 30), (5, 60_000_000, 11)])
def test_storms(spark, seed, window, run_rows):
    rows = events(seed)
    df = spark.createDataFrame(rows, "key string, us bigint, tie bigint")
    got = {(r.key, r.tie): r["count"] for r in T.fold_storms(df, "key", "us", "tie", window, run_rows=run_rows, slice_us=5_000_000).collect()}
    assert got == storms_by_hand(rows, window)


def test_storm_fixture(spark):
    df = spark.createDataFrame([("a", s * 1_000_000, s) for s in (0, 1, 2, 3, 4, 5, 11)], "key string, us bigint, tie bigint")
    got = T.storm_lines(T.fold_storms(df, "key", "us", "tie")).orderBy("us").collect()
    assert [(r.us, r["count"], r.repeated, r.window_sec) for r in got] == [(0, 1, None, None), (11_000_000, 6, 6, 10)]


@pytest.mark.parametrize("width", [1, 1000, 1_000_000, 10**12])
def test_ranking_equals_plain_window(spark, width):
    pdf = pd.DataFrame(events(9), columns=["key", "us", "tie"])
    df = spark.createDataFrame(pdf)
    slice_ = F.floor(F.col("us") / width)
    ranks = {(r.key, r.tie): r["rank"] for r in sliced_rank(df, ["key"], ["us", "tie"], slice_, fanout=3).collect()}
    pdf = pdf.sort_values(["us", "tie"])
    want = dict(zip(zip(pdf.key, pdf.tie), pdf.groupby("key").cumcount() + 1))
    assert ranks == want
    prev = {(r.key, r.tie): r.previous for r in sliced_previous(df, ["key"], ["us", "tie"], "tie", slice_).collect()}
    lag = pdf.groupby("key")["tie"].shift()
    assert prev == {k: None if pd.isna(v) else int(v) for k, v in zip(zip(pdf.key, pdf.tie), lag)}


def test_running_sum(spark):
    df = spark.createDataFrame([("a", i % 50, i) for i in range(500)], "key string, b bigint, v bigint")
    got = {r.b: r.running for r in running_sum(df, ["key"], "b", "v", fanout=7).collect()}
    total, want = 0, {}
    for b in range(50):
        total += sum(i for i in range(500) if i % 50 == b)
        want[b] = total
    assert got == want


FORCED_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


@pytest.fixture
def forced_skew(spark):
    old = {k: spark.conf.get(k, None) for k in FORCED_SKEW}
    for k, v in FORCED_SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_folds_hold_when_joins_split_skewed_partitions(forced_skew):
    rows = events(21, n=4000)
    df = forced_skew.createDataFrame(rows, "key string, us bigint, tie bigint").repartition(8, "tie")
    got = {(r.key, r.tie): r.allowed for r in T.token_bucket(df, "key", "us", "tie", 1, 3, run_rows=700).collect()}
    assert got == {k: v[0] for k, v in bucket_by_hand(rows, 1, 3).items()}
    lines = {(r.key, r.tie): r["count"] for r in T.fold_storms(df, "key", "us", "tie", 2_000_000, run_rows=700).collect()}
    assert lines == storms_by_hand(rows, 2_000_000)


def test_short_runs_of_missing_keys_and_no_call_per_run(spark):
    rows = [(None if k == "hot" else int(k[1:]), us, i) for k, us, i in events(31, n=300)]
    df = spark.createDataFrame(rows, "key bigint, us bigint, tie bigint")
    bucket = T.token_bucket(df, "key", "us", "tie", 1, 2, run_rows=7)
    assert "FlatMapGroupsIn" not in bucket._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.tie): r.allowed for r in bucket.collect()} == {k: v[0] for k, v in bucket_by_hand(rows, 1, 2).items()}
    storms = T.fold_storms(df, "key", "us", "tie", 2_000_000, run_rows=9)
    assert "FlatMapGroupsIn" not in storms._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.tie): r["count"] for r in storms.collect()} == storms_by_hand(rows, 2_000_000)
