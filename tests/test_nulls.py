"""NULL keys and repeated rows: no row is lost, and no plaintext passes."""

import pytest
from pyspark.sql import functions as F

from maskwork.operators import joins as J
from maskwork.operators import metrics as A
from maskwork.operators import ordering as W
from maskwork.operators import redact as R
from maskwork.operators import vault as V
from maskwork.operators.limits import token_bucket
from maskwork.sources.corpus import scan_corpus

PART = "request_id string, session_id string, msg_idx int, text string"


def test_parts_without_ids_are_redacted_and_restored(spark):
    rows = [("r", None, 0, "ssn 123-45-6789"), (None, None, 1, "ssn 123-45-6789 a@b.co"), (None, "s", None, "mail a@b.co"),
            ("d", "s", 2, "mail x@y.org"), ("d", "s", 2, "mail a@b.co 123-45-6789")]
    parts = spark.createDataFrame(rows, PART)
    redacted, found, vault = R.redact_tier1(parts, ["request_id", "msg_idx"], "session_id", "text", ["msg_idx"], {})
    texts = [r.text for r in redacted.collect()]
    assert len(texts) == len(rows) and not any("123-45-6789" in t or "@" in t for t in texts)
    assert R.find_leaks(parts, redacted, ["request_id", "msg_idx"], "text", R.TIER1_KINDS).count() == 0
    assert R.find_leaks(parts, parts, ["request_id", "msg_idx"], "text", R.TIER1_KINDS).count() > 0
    single = redacted.where("request_id is null or request_id = 'r'")
    back = V.restore(single, ["request_id", "msg_idx"], "session_id", "text", vault)
    assert sorted(r.text for r in back.collect()) == sorted(t for q, *_, t in rows if q != "d")
    found.unpersist()


def test_folds_keep_null_keys(spark):
    events = spark.createDataFrame([(None, 1, 1), ("a", 2, 2), (None, 3, 3)], "k string, us bigint, tie bigint")
    assert token_bucket(events, "k", "us", "tie", 1, 2).count() == 3
    levels = A.gauge_levels(events.withColumn("d", F.lit(1)), ["k"], "us", "d")
    assert {(r.k, r.level) for r in levels.collect()} == {(None, 2), ("a", 1)}
    steps = spark.createDataFrame([(None, 1, 1, "open"), (None, 2, 2, "closed"), ("s", None, 3, "open")],
                                  "sid string, us bigint, tie bigint, state string")
    assert W.lifecycle_check(steps, "sid", "us", "tie", "state").count() == 3


def test_one_row_per_key_however_many_pieces(spark):
    pieces = spark.range(5000).select(F.lit("r").alias("request"), F.col("id").alias("msg"), F.lit("system").alias("role"),
                                      F.concat(F.lit("t"), "id").alias("text"))
    system, _ = W.hoist_system(pieces, "request", "msg", "role", "text")
    rows = system.collect()
    assert len(rows) == 1 and rows[0].text == "\n".join(f"t{i}" for i in range(5000))


def test_nothing_is_capped_by_default(spark):
    df = spark.range(3000).select(F.col("id").alias("us"), F.col("id").alias("tie"), F.lit("allowed").alias("verdict"))
    assert W.recent(df, "us", "tie", None).count() == 3000 and W.tail_lines(df, "us", "tie", 0).count() == 3000
    assert A.verdict_counts(df, "us", "tie").first().buffered == 3000
    docs = spark.createDataFrame([("x" * 50,), ("y",), (None,)], "text string")
    assert scan_corpus(docs, "text").where("oversized").count() == 0 and scan_corpus(docs, "text").count() == 3
    assert [r.oversized for r in scan_corpus(docs, "text", 10).orderBy(F.length("text").desc()).collect()] == [True, False, False]


def test_policies_are_checked_and_never_shuffled(spark):
    found = spark.createDataFrame([("ssn",), ("email",), ("phone",), (None,)], "kind string")
    schema = "kind string, action string"
    prefs = spark.createDataFrame([("ssn", "warn"), ("ssn", "warn"), ("email", "")], schema)
    rules = spark.createDataFrame([("email", "block"), ("phone", "unknown")], schema)
    acted = R.resolve_action_layered(found, prefs, rules)
    got = {r.kind: r.action for r in acted.collect()}
    assert got["ssn"] == "warn" and got["email"] == "block" and len(got) == 4
    assert "Exchange" not in acted._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        R.resolve_action_layered(found, spark.createDataFrame([("ssn", "warn"), ("ssn", "block")], schema), rules)


def test_addresses(spark):
    from maskwork.catalog.traffic import ADDRESSES

    df = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    assert {r.ip: r.c for r in df.select("ip", J.ip_class(F.col("ip")).alias("c")).collect()} == ADDRESSES
