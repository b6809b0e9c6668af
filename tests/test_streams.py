"""Stateful stream operators against plain Python, over several micro-batches."""

import random

import pandas as pd
import pytest

from maskwork.operators.limits import token_bucket
from maskwork.session import shared_dir
from maskwork.streaming import flows, state
from maskwork.streaming.run import read_stream, run_complete, run_to_table
from test_folds import bucket_by_hand, events, storms_by_hand


def as_stream(spark, rows, schema, pieces=3):
    """Rows in order over several files, read one file per micro-batch."""
    path = shared_dir(spark, "source")
    size = -(-len(rows) // pieces)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, files_per_trigger=1)


SCHEMA = "key string, us bigint, tie bigint"


def test_bucket_over_batches(spark):
    rows = events(11, n=200)
    out = run_to_table(state.token_bucket_stream(as_stream(spark, rows, SCHEMA), "key", "us", "tie", 1, 2), "b")
    got = {(r.key, r.tie): (r.allowed, pytest.approx(r.retry_after)) for r in out.collect()}
    assert got == bucket_by_hand(rows, 1, 2)


def test_storms_over_batches(spark):
    rows = events(12, n=200)
    out = run_to_table(state.fold_storms_stream(as_stream(spark, rows, SCHEMA), "key", "us", "tie", 3_000_000), "s")
    assert {(r.key, r.tie): r["count"] for r in out.collect()} == storms_by_hand(rows, 3_000_000)


def test_a_token_split_over_chunks_is_restored_only_when_assembled(spark):
    vault = spark.createDataFrame([("s", "[SSN_1_ab]", "123-45-6789")], "sid string, pseudonym string, plaintext string")
    pieces = [("r", "s", 0, "it is [SSN_"), ("r", "s", 1, "1_ab] ok [SSN_1_ab]")]
    stream = as_stream(spark, pieces, "req string, sid string, seq int, text string", pieces=1)
    plain = flows.restore_stream(stream, ["req", "seq"], "sid", "text", vault)
    assert {r.seq: r.text for r in plain.collect()} == {0: "it is [SSN_", 1: "1_ab] ok 123-45-6789"}
    chunks = spark.createDataFrame(pieces, "req string, sid string, seq int, text string")
    whole = flows.restore_assembled(chunks, "req", "sid", "seq", "text", vault).first()
    assert whole.text == "it is 123-45-6789 ok 123-45-6789"


def test_latest_version_wins(spark):
    df = spark.createDataFrame(pd.DataFrame({"doc": [1, 1, 2], "v": [1, 2, 1], "text": ["a", "b", "c"]}))
    assert sorted(tuple(r) for r in flows.latest_versions(df, "doc", "v").collect()) == [(1, 2, "b"), (2, 1, "c")]


def test_totals_and_board_over_batches(spark):
    rows = [(i, i * 10, "allowed" if i % 3 else "redacted") for i in range(12)]
    schema = "request_id bigint, us bigint, verdict string"
    totals = run_complete(flows.live_totals(as_stream(spark, rows, schema, pieces=4)), "t").collect()
    assert [(r.total, r.allowed, r.redacted) for r in totals] == [(12, 8, 4)]
    board = flows.live_board(as_stream(spark, rows, schema, pieces=4), "us", "request_id", 5)
    assert sorted(r.request_id for r in board.collect()) == [7, 8, 9, 10, 11]


@pytest.mark.parametrize("rate, burst", [(7001, 2), (9999, 1), (0.3, 2)])
def test_bucket_with_present_day_times(spark, rate, burst):
    from fractions import Fraction

    start, rng = 1_790_000_000_000_000, random.Random(1)
    rows = [("k", start + i * 90 + rng.randrange(60), i) for i in range(400)]
    level, last, want = Fraction(burst), rows[0][1], {}
    for _, us, tie in sorted(rows, key=lambda r: (r[1], r[2])):
        level = min(Fraction(burst), level + Fraction(us - last, 1_000_000) * Fraction(str(rate)))
        last = us
        want[tie] = level >= 1
        level -= want[tie]
    df = spark.createDataFrame(rows, SCHEMA)
    for run_rows in (500_000, 50):
        got = token_bucket(df, "key", "us", "tie", rate, burst, run_rows=run_rows)
        assert {r.tie: r.allowed for r in got.collect()} == want
    out = run_to_table(state.token_bucket_stream(as_stream(spark, rows, SCHEMA), "key", "us", "tie", rate, burst), "b")
    assert {r.tie: r.allowed for r in out.collect()} == want


def test_buckets_of_one_group_are_kept_apart_and_few_groups_hold_many_keys(spark):
    rows = [(f"k{i % 37}" if i % 5 else key, us, i) for i, (key, us, _) in enumerate(events(13, n=300))]
    progress = []
    out = run_to_table(state.token_bucket_stream(as_stream(spark, rows, SCHEMA), "key", "us", "tie", 1, 2, groups=3), "g", progress)
    assert {(r.key, r.tie): (r.allowed, pytest.approx(r.retry_after)) for r in out.collect()} == bucket_by_hand(rows, 1, 2)
