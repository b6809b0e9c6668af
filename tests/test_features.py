"""Sketches, typed logs, as-of candidates and policies that fail alone."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from maskwork.operators import logs as L
from maskwork.operators import routing as Q
from maskwork.operators import sketches as S
from maskwork.session import shared_dir
from maskwork.sources.logs import read_typed_logs, stream_logs
from maskwork.streaming.run import run_to_table

DAY = S.DAY_US


# ---- sketches

def test_rolling_series_is_close_to_the_exact_count(spark):
    rng = random.Random(1)
    rows = [("m" + str(rng.randrange(2)), rng.randrange(40) * DAY + rng.randrange(DAY), rng.randrange(4000), rng.choice(["a", None])) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "metric string, us bigint, user int, label string")
    daily = S.series_sketches(df, "metric", "us", ["user", "label"])
    path = shared_dir(spark, "sketches")
    S.write_days(daily, path)
    S.write_days(daily.where("day = 7"), path)  # a day scanned anew replaces itself only
    stored = spark.read.parquet(path)
    assert stored.count() == daily.count() == 80
    for dims in (["metric"], []):
        got = {(r["day"], r["metric"] if dims else None): r for r in S.rolling_series(stored, dims, 30, 9000, 20_000).collect()}
        for (day, metric), r in got.items():
            exact = len({(m, u, x) for m, us, u, x in rows if day - 29 <= us // DAY <= day and metric in (None, m)})
            assert abs(r["series"] - exact) <= 0.03 * exact
            assert r["state"] == ("warn" if r["series"] >= 9000 else "ok")
        assert {d for d, _ in got} == set(range(40))


def test_rolling_latency_keeps_its_rank_error(spark):
    rng = random.Random(2)
    rows = [(rng.choice("SL"), rng.randrange(10) * DAY, int(rng.expovariate(0.01))) for _ in range(60_000)] + [("S", DAY, None), ("Q", 50 * DAY, 5)]
    df = spark.createDataFrame(rows, "class string, us bigint, ms bigint")
    got = S.rolling_latency(S.latency_sketches(df, ["class"], "us", "ms"), ["class"], 4).collect()
    assert len(got) == 21
    for r in got:
        held = sorted(ms for c, us, ms in rows if c == r["class"] and ms is not None and r["day"] - 3 <= us // DAY <= r["day"])
        assert r["requests"] == len(held)
        for q, value in ((0.95, r["p95"]), (0.99, r["p99"])):
            below, upto = sum(x < value for x in held), sum(x <= value for x in held)
            assert below / len(held) <= q + 0.01 and upto / len(held) >= q - 0.01


# ---- logs

def lines(n):
    out = [json.dumps({"ts": f"2024-01-01T00:00:{i:02d}Z", "level": "info", "msg": f"m{i}", "n": i, "ok": i % 2 == 0, "share": i / 8, "user": {"id": i, "tags": ["a", i]}}) for i in range(n)]
    return out + ["", "plain text", "[1]", '{"a": 1', '{"a":1,"a":2}', "  {}  ", '{"ts": "never", "level": 5}']


def test_typed_logs_of_a_stream_equal_those_of_a_batch(spark):
    path, rows = shared_dir(spark, "logs"), lines(20)
    for part in (rows[:9], rows[9:22], rows[22:]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(path)
    shown = lambda df: sorted(map(repr, df.withColumn("fields", F.to_json("fields")).collect()))
    got = run_to_table(stream_logs(spark, path, 1), "logs")
    batch = read_typed_logs(spark, path)
    assert shown(got) == shown(batch) and got.count() == 27
    errors = {r.raw: r.error for r in got.where("error is not null").collect()}
    assert errors == {"": "empty line", "plain text": "not a JSON object", "[1]": "not a JSON object", '{"a": 1': "not a JSON object",
                      '{"a":1,"a":2}': "not a JSON object"}
    one = got.where("msg = 'm3'").selectExpr(
        "fields:n::bigint + 1 as n", "schema_of_variant(fields:ok) as ok", "schema_of_variant(fields:user.id) as id", "fields:user.tags[1]::int as tag", "level").first()
    assert tuple(one) == (4, "BOOLEAN", "BIGINT", 3, "info")


def test_nested_log_fields(spark):
    record = {"ts": "x", "msg": "sk-abcdef123", "n": 1, "f": 1.5, "b": True, "z": None, "Session_Token": "abc", "cookie": 7, "secret_list": [1, {"a": 2}], "api_key": None,
              "user": {"name": "a\tb sk-abcdef123", "token": {"x": 1}, "deep": [{"password": "", "ok": False}, ["q\nr", 3]], "ts": "kept"}, "e": {}, "l": []}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, None), (3, "{}"), (4, '{"msg": "only"}')], "id int, line string").withColumn("v", F.try_parse_json("line"))
    rows = L.redact_variant_fields(df, "id", "v").select("id", "path", F.to_json("value").alias("value")).collect()
    assert {r.id for r in rows} == {1}
    got = {r.path: json.loads(r.value) for r in rows}
    hidden = got.pop("Session_Token")
    assert hidden.startswith("<redacted len=3 sha256-first-8=")
    assert got == {
        "n": 1, "f": 1.5, "b": True, "z": None, "cookie": "<redacted>", "secret_list": "<redacted>", "api_key": "<redacted>", "user.name": "a b <redacted-secret>",
        "user.token": "<redacted>", "user.deep[0].password": "<empty>", "user.deep[0].ok": False, "user.deep[1][0]": "q r", "user.deep[1][1]": 3, "user.ts": "kept", "e": {}, "l": []}
    assert len(rows) == len(got) + 1


def test_nested_log_fields_are_parsed_once_and_written_once(spark, monkeypatch):
    levels, write = [], L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, name: levels.append(df) or write(df, name))
    record = {"a": [None], "b": {"x": None}, "c": [[], {}], "d": "{}", "e": [], "f": {}, "g": "[]", "h": "xoxb-0123456789 ghp_abcdefghij0123456789_", "token": "t"}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "null")], "id int, line string").withColumn("v", F.try_parse_json("line"))
    got = {r.path: json.loads(r.value) for r in L.redact_variant_fields(df, "id", "v").select("path", F.to_json("value").alias("value")).collect()}
    assert got.pop("token").startswith("<redacted len=1 ")
    assert got == {"a[0]": None, "b.x": None, "c[0]": [], "c[1]": {}, "d": "{}", "e": [], "f": {}, "g": "[]", "h": "<redacted-secret> <redacted-secret>"}
    assert levels[0]._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert all((r.x is None) == (r.shown is not None) for r in levels[0].select(F.to_json("x").alias("x"), "shown").collect())


# ---- routing

@pytest.mark.parametrize("slice_us", [7, 10**9])
def test_candidates_as_of_each_request(spark, slice_us):
    rng = random.Random(3)
    sends = [(rng.randrange(200), rng.choice(["openai-default", "ollama-local", "other", None]), rng.choice([200, 503, None]), rng.choice([None, "reset"])) for _ in range(400)]
    asked = [(i, rng.randrange(-5, 210)) for i in range(100)] + [(900, None), (901, 50), (901, 50)]
    requests = spark.createDataFrame(asked, "id int, us bigint")
    got = Q.snapshots_as_of(requests, spark.createDataFrame(sends, "us bigint, upstream string, status int, net_error string"), "us", "upstream", "status", "net_error", slice_us=slice_us)
    rows = got.collect()
    assert got.columns == ["id", "us", "candidates"] and sorted((r.id, r.us) for r in rows if r.us is not None) == sorted(a for a in asked if a[1] is not None)
    for r in rows:
        for c in r.candidates:
            own = [s for s in sends if r.us is not None and s[1] == c.id and s[0] <= r.us]
            failed = sum(s[3] is not None or (s[2] or 0) >= 500 for s in own)
            rate = failed / len(own) if own else 0.0
            assert math.isclose(c.error_rate, rate)
            assert c.health == ("healthy" if len(own) < 10 or rate <= 0.1 else "unavailable" if rate > 0.5 else "degraded")


def test_a_policy_fails_alone(spark):
    requests = spark.createDataFrame([(1, "4", 0), (2, "x", 2), (3, None, 5), (4, "7", 1)], "id int, model string, n int")
    candidates = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind")) for i, k in (("a", "one"), ("b", "two"))])
    policies = [
        Q.Policy("syntax", "candidate.kind ="), Q.Policy("column", "nothing > 1"), Q.Policy("cast", "cast(model as int) > 5 and candidate.kind = 'two'"),
        Q.Policy("division", "10 / n > 4 and candidate.kind = 'one'"), Q.Policy("stranger", verdict="'nobody'"), Q.Policy("last", verdict="case when id < 3 then 'b' end")]
    before = spark.conf.get("spark.sql.ansi.enabled")
    rows = {r.id: (r.upstream, r.policy, r.policy_errors, r.trace.count(","), r.route_error) for r in Q.route(requests.withColumn("candidates", candidates), policies).collect()}
    assert rows == {
        1: ("b", "last", "syntax,column,division", 5, None), 2: ("a", "division", "syntax,column,cast", 3, None),
        3: (None, None, "syntax,column,cast,last", 5, "cap_mismatch"), 4: ("b", "cast", "syntax,column", 2, None)}
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    empty = Q.route(requests.withColumn("candidates", F.filter(candidates, lambda c: F.lit(False))), policies).first()
    assert (empty.upstream, empty.trace, empty.policy_errors, empty.route_error) == (None, "", "", "cap_mismatch")
