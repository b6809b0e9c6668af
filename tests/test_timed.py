"""Stream operators that live by the watermark: several micro-batches against batch forms, and state that goes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwork.catalog import streams
from maskwork.operators.joins import with_optout
from maskwork.session import shared_dir
from maskwork.streaming import flows, state, timed
from maskwork.streaming.run import read_stream, run_to_table
from test_folds import storms_by_hand

END = 10**12


def batches(spark, parts, schema):
    """A stream with one micro-batch per list of rows."""
    path = shared_dir(spark, "source")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, files_per_trigger=1)


def held(progress):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]


def dropped(progress):
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def timed_stream(spark, parts, schema, us="us"):
    return batches(spark, parts, schema).withColumn("at", F.timestamp_micros(us))


def test_optout_of_two_streams(spark):
    rng, hour = random.Random(3), 3_600_000_000
    grants = sorted((rng.randrange(12 * hour), f"s{rng.randrange(4)}") for _ in range(12))
    grants = [(s, t) for t, s in grants for _ in range(2)]  # a repeated grant does not repeat a request
    requests = sorted((rng.randrange(12 * hour), f"s{rng.randrange(5)}", i) for i in range(80))
    requests = [(s, t, i) for t, s, i in requests] + [(grants[0][0], grants[0][1] + hour, 900), (grants[0][0], grants[0][1] + hour + 1, 901)]
    requests.sort(key=lambda r: r[1])
    thirds = lambda rows, i: [r for r in rows if 4 * hour * i <= r[1] < 4 * hour * (i + 1)]
    asked = [thirds(requests, i) for i in range(4)] + [[("end", END, -1)]]
    given = [thirds(grants, i) for i in range(4)] + [[("end", END)]]
    asked, given = [p for p in asked if p], [p for p in given if p]
    progress = []
    flagged = timed.optout_join(
        timed_stream(spark, asked, "session string, us bigint, tie bigint"),
        timed_stream(spark, given, "session string, us bigint").drop("us"), "session", "at", "tie")
    got = run_to_table(flagged.select("tie", "opted_out"), "optout", progress)
    want = with_optout(spark.createDataFrame(requests, "session string, us bigint, tie bigint"),
                       spark.createDataFrame(grants, "session string, us bigint"), "session", "us")
    rows = {(r.tie, r.opted_out) for r in want.collect()}
    assert sorted((r.tie, r.opted_out) for r in got.where("tie >= 0").collect()) == sorted(rows)
    assert {f for _, f in rows} == {True, False}
    assert max(held(progress)) > 10 and held(progress)[-1] <= 4  # what is left is the ending rows'


def test_optout_keeps_a_group_of_sessions_as_one_row(spark):
    """Grants of a busy session are no rows of the state; requests keep their values, also beside missing ones."""
    big, schema = (1 << 53) + 1, "session string, us bigint, tie bigint, n bigint, d double, b binary, s string"
    rows = [("s", 10_000_000 + i, big + i, None if i % 2 else big, i / 3, b"\xff", 'q"\n\u00e9') for i in range(10)]
    rows += [("s", 9_000_000 + 10_000_001, 1, 5, None, None, None), (None, 10_000_000, 2, 5, float("nan"), None, "")]
    given = [("s", 1_000_000 + i * 20_000) for i in range(400)] + [("s", 9_000_000), (None, 9_999_999)]
    asked = [rows[:6], rows[6:], [(None, END, -1, 0, 0.0, None, None)]]  # without a session, it still moves the watermark
    given, progress = [given[:200], given[200:], [(None, END)]], []
    requests = timed_stream(spark, asked, schema)
    flagged = timed.optout_join(requests, timed_stream(spark, given, "session string, us bigint").drop("us"), "session", "at", "tie", ttl_us=10_000_000)
    assert flagged.dtypes == [*requests.dtypes, ("opted_out", "boolean")]
    got = {r.tie: r for r in run_to_table(flagged, "optout", progress).where("tie >= 0").collect()}
    assert {t: r.opted_out for t, r in got.items()} == {r[2]: r[2] >= big for r in rows}
    assert [repr(tuple(got[r[2]])[:7]) for r in rows] == [repr(r) for r in rows]
    assert all(got[r[2]].at.microsecond == r[1] % 1_000_000 for r in rows)
    assert max(held(progress)) <= len(rows) + 8


def test_late_requests_are_dropped_and_counted(spark):
    asked = [[("a", 10_000_000, 1)], [("a", 90_000_000, 2)], [("a", 5_000_000, 3)], [("end", END, -1)]]
    given = [[("a", 9_000_000)], [("a", 90_000_000)], [("b", 91_000_000)], [("end", END)]]
    progress = []
    flagged = timed.optout_join(
        timed_stream(spark, asked, "session string, us bigint, tie bigint"),
        timed_stream(spark, given, "session string, us bigint").drop("us"), "session", "at", "tie", ttl_us=2_000_000)
    got = run_to_table(flagged.select("tie", "opted_out"), "optout", progress)
    assert {(r.tie, r.opted_out) for r in got.where("tie >= 0").collect()} == {(1, True), (2, True)}
    assert dropped(progress) == 1


VERSIONS = "doc bigint, version bigint, ms bigint, text string"


def test_a_document_is_scanned_once_it_is_quiet(spark):
    parts = [[(1, 1, 1000, "a"), (2, 1, 1000, "x")], [(1, 2, 1400, "b"), (3, 1, 1450, "q")], [(1, 3, 1800, "c ssn 123-45-6789"), (2, 2, 1800, None)],
             [(2, 3, 2300, "later"), (3, 2, 2200, "r")], [(-1, 0, 10**9, "")]]
    stream = batches(spark, parts, VERSIONS).withColumn("at", F.timestamp_millis("ms")).drop("ms")
    progress = []
    got = run_to_table(timed.quiet_stream(stream, "doc", "version", "at", "text"), "quiet", progress)
    rows = {(r.doc, r.version): r.text for r in got.collect()}
    assert rows == {(1, 3): "c ssn 123-45-6789", (2, 1): "x", (2, 2): None, (2, 3): "later", (3, 1): "q", (3, 2): "r"}
    assert got.count() == len(rows)
    assert held(progress)[-1] <= 3  # the ending row's version and its timer
    scanned = flows.scan_stream(got, ["doc", "version"], "text")
    assert [(r.doc, r.kind) for r in scanned.collect()] == [(1, "ssn")]


def test_a_quiet_document_is_one_row_of_the_state(spark):
    first = [(i, v, 1000 + v, f"{i} {v}") for i in range(40) for v in range(3)]
    # the row at 2600 is behind the watermark, yet its session is open
    parts = [first, [(100, 1, 3000, "x")], [(100, 2, 3001, "y")], [(101, 1, 2600, "z")], [(-1, 0, 10**9, "")]]
    stream = batches(spark, parts, VERSIONS).withColumn("at", F.timestamp_millis("ms")).drop("ms")
    progress = []
    got = run_to_table(timed.quiet_stream(stream, "doc", "version", "at", "text"), "quiet", progress).where("doc >= 0").collect()
    assert sorted((r.doc, r.version, r.ms, r.text) for r in got) == [*[(i, 2, 1002, f"{i} 2") for i in range(40)], (100, 2, 3001, "y"), (101, 1, 2600, "z")]
    assert held(progress)[0] == 40
    with pytest.raises(ValueError):
        timed.quiet_stream(stream, "doc", "version", "at", "text", quiet_ms=0)


@pytest.mark.parametrize("seed", range(2))
def test_quiet_stream_equals_the_batch_form(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), i, 1000 + rng.randrange(400) * 100, f"t{i}") for i in range(150)]
    rows.sort(key=lambda r: r[2])
    cuts = [0, 40, 90, 150]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    stream = batches(spark, [*parts, [(-1, 0, 10**9, "")]], VERSIONS).withColumn("at", F.timestamp_millis("ms")).drop("ms")
    got = run_to_table(timed.quiet_stream(stream, "doc", "version", "at", "text", late="1 second"), "quiet")
    want = timed.quiet_versions(spark.createDataFrame(rows, VERSIONS), "doc", "version", "ms", slice_ms=3000)
    assert {(r.doc, r.version, r.text) for r in got.collect()} == {(r.doc, r.version, r.text) for r in want.collect()}
    by_hand = {r[1] for r in rows if not any(
        o[0] == r[0] and (o[2], o[1]) > (r[2], r[1]) and o[2] - r[2] < 500 for o in rows)}
    assert {r.version for r in want.collect()} == by_hand


VAULT = [("s", "[SSN_1_ab]", "123-45-6789"), ("s", "[API_KEY_22_x-Y_9]", "sk_live"), ("t", "[SSN_1_cd]", "987-65-4321")]
TEXTS = {("s", "r1"): "it is [SSN_1_ab][API_KEY_22_x-Y_9] and [SSN_1_cd] [x [SSN_1_", ("t", "r2"): "[[SSN_1_cd]] [SSN_2_zz] end ["}
CHUNK, KNOWN = "sid string, req string, seq int, text string, ms bigint", "sid string, pseudonym string, plaintext string, ms bigint"


def _restored(spark, chunks, vault, progress=None, **kw):
    both = [batches(spark, parts, schema).withColumn("at", F.timestamp_millis("ms")) for parts, schema in ((chunks, CHUNK), (vault, KNOWN))]
    out = timed.restore_with_vault(*both, "sid", "req", "seq", "text", "at", **kw)
    rows = run_to_table(out, "restored", progress).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.seq, r.piece)):
        texts[(r.sid, r.req)] = texts.get((r.sid, r.req), "") + r.text
    return texts


def assembled(spark, chunks, vault):
    df = spark.createDataFrame([c for part in chunks for c in part if c[0] != "end"], CHUNK)
    known = spark.createDataFrame([v for part in vault for v in part if v[0] != "end"], KNOWN)
    return {(r.sid, r.req): r.text for r in flows.restore_assembled(df, "req", "sid", "seq", "text", known).collect()}


def test_tokens_cut_at_every_position(spark):
    """One stream per position, all of one session and vault, over three batches."""
    first, second = [], []
    for (sid, name), text in TEXTS.items():
        for at in range(len(text) + 1):
            first.append((sid, f"{name}-{at}", 0, text[:at], 1000))
            second.append((sid, f"{name}-{at}", 1, text[at:], 2000))
    chunks = [first, second, [("end", "end", 0, "", 10**8)]]
    vault = [[(*v, 900) for v in VAULT], [("end", "p", "q", 10**8)]]
    progress = []
    got = _restored(spark, chunks, vault, progress)
    got.pop(("end", "end"), None)
    assert got == assembled(spark, chunks, vault)
    assert held(progress)[-1] <= 8  # the ending rows' session


def test_chunks_in_single_characters_and_late_vault_rows(spark):
    text = TEXTS[("s", "r1")]
    chunks = [[("s", "r", i, text[i], 1000 + i) for i in range(a, min(a + 25, len(text)))] for a in range(0, len(text), 25)]
    chunks.append([("end", "end", 0, "", 10**8)])
    vault = [[("u", "[A_1_b]", "x", 1000)], [("s", "[SSN_1_ab]", "123-45-6789", 1040)], [("s", "[API_KEY_22_x-Y_9]", "sk_live", 1060)], [("end", "p", "q", 10**8)]]
    got = _restored(spark, chunks, vault, wait_ms=5000)
    assert got[("s", "r")] == assembled(spark, chunks, vault)[("s", "r")]


def test_unfinished_tokens():
    token = "[API_KEY_22_x-Y_9]"
    for at in range(1, len(token)):
        assert timed.unfinished("ab " + token[:at]) == 3
    for whole in ("", "ab", token, token + " x", "[ab", "[A b", "[A_1_b c", "[1", "[A_1]"):
        assert timed.unfinished(whole) == len(whole) or re.search(r"\[[A-Z_]*$", whole)


def test_idle_storms_and_ended_streams_leave_the_state(spark):
    rows = [("a", (i + 1) * 1_000_000, i) for i in range(5)] + [("b", 2_000_000, 50)]
    later = [("a", 100_000_000, 60), ("c", 101_000_000, 61)]
    stream = timed_stream(spark, [rows, [("c", 60_000_000, 59)], [("b", 99_000_000, 51)], later, [("end", END, -1)]], "key string, us bigint, tie bigint").withWatermark("at", "0 seconds")
    progress = []
    out = run_to_table(state.fold_storms_stream(stream, "key", "us", "tie", 10_000_000, "at", 20_000), "s", progress)
    got = {(r.key, r.tie): r["count"] for r in out.collect()}
    plain = storms_by_hand([*rows, ("c", 60_000_000, 59), ("b", 99_000_000, 51), *later, ("end", END, -1)], 10_000_000)
    # what storm a had folded comes out at its last event, not with the next one
    assert plain[("a", 60)] == 5 and got[("a", 4)] == 4 and got[("a", 60)] == 1
    assert {k: v for k, v in got.items() if k[0] != "a"} == {k: v for k, v in plain.items() if k[0] != "a"}
    assert sum(got.values()) == 11 and held(progress)[-1] <= 4
    with pytest.raises(ValueError):
        state.fold_storms_stream(stream, "key", "us", "tie", 10_000_000, "at", 5)

    parts = [[("x", 1, "a", None, 1000), ("x", 2, "b", "bad", 1500), ("y", 1, "c", None, 1600)], [("x", 3, "d", None, 2000)], [("z", 1, "q", None, 90_000)],
             [("x", 1, "new", None, 95_000)], [("end", 0, "", None, 10**9)]]
    chunks = batches(spark, parts, "stream string, seq bigint, delta string, err string, ms bigint")
    chunks = chunks.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds")
    progress = []
    cut = run_to_table(state.cut_on_error_stream(chunks, "stream", "seq", "delta", "err", "at", 30_000), "cut", progress)
    assert sorted(r.delta for r in cut.collect()) == ["", "a", "b", "c", "new", "q"]
    assert held(progress)[-1] == 0


def test_slices_take_files_by_bytes_and_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_BYTES", 500)
    taken = []
    monkeypatch.setattr(streams, "read_stream", lambda s, path, files: taken.append((path, files)))
    # one value of the order holds most rows, so some parts and slices are empty
    docs = spark.range(100).select("id", F.when(F.col("id") < 80, 0).otherwise(F.col("id")).alias("o"), F.expr("repeat('x', 100)").alias("text"))
    streams.sliced(spark, docs, "bytes", "o")()
    (path, files), = taken
    rows = spark.read.parquet(path).select("id", "o", "_metadata.file_path", "_metadata.file_modification_time").collect()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    parts = sorted((f for f in listed if f.getPath().getName().startswith("part-")), key=lambda f: f.getModificationTime())
    assert files == 5 and len(parts) == 4 * files and len(rows) == 100
    batch = {f.getPath().getName(): i // files for i, f in enumerate(parts)}
    spans = {}
    for r in rows:
        spans.setdefault(batch[r.file_path.rsplit("/", 1)[1]], set()).add(r.o)
    assert sum(len(v) for v in spans.values()) == len(set().union(*spans.values()))  # no value in two batches
    edges = [(min(v), max(v)) for _, v in sorted(spans.items())]
    assert edges == sorted(edges) and len(edges) > 1


def test_streams_that_share_a_watermark_are_cut_at_the_same_times(spark, monkeypatch):
    """One stream with its rows at the start, one with its rows at the end: no batch of one is older than an earlier one of the other."""
    early = spark.range(100).select((F.when(F.col("id") < 90, F.col("id")).otherwise(F.col("id") * 10)).alias("ms")).withColumn("at", F.timestamp_millis("ms"))
    late = spark.range(100).select((F.when(F.col("id") < 10, F.col("id")).otherwise(900 + F.col("id"))).alias("ms")).withColumn("at", F.timestamp_millis("ms"))
    cuts = []
    monkeypatch.setattr(streams, "_write_slices", lambda s, slices, files, path: cuts.append([sorted(r.ms for r in x.collect()) for x in slices]))
    monkeypatch.setattr(streams, "read_stream", lambda s, path, files: None)
    streams.sliced_alike(spark, {"a": early, "b": late}, "at", {})
    spans = [a + b for a, b in zip(*cuts)]
    assert len(spans) == 4 and sum(map(len, spans)) == 200
    spans = [x for x in spans if x]
    assert len(spans) > 1 and all(max(x) < min(y) for x, y in zip(spans, spans[1:]))


def test_idle_buckets_leave_the_state_of_their_group(spark):
    rows = [(f"k{i}", (i + 1) * 1000, i) for i in range(50)]  # a row at time 0 is late from the start
    later = [("k0", 100_000_000, 60), ("k0", 100_000_001, 61), ("k0", 100_000_002, 62)]
    stream = timed_stream(spark, [rows, [("k1", 60_000_000, 59)], later, [("end", END, -1)]], "key string, us bigint, tie bigint").withWatermark("at", "0 seconds")
    progress = []
    out = run_to_table(state.token_bucket_stream(stream, "key", "us", "tie", 1, 2, "at", 20_000, groups=2), "b", progress)
    got = {(r.key, r.tie): r.allowed for r in out.collect()}
    assert len(got) == 55 and not got.pop(("k0", 62)) and all(got.values())
    assert held(progress)[0] == 2 and held(progress)[-1] == 1  # Spark counts one row a group; what is left is the ending row's
