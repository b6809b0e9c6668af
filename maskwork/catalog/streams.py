"""Streaming queries. Each reads the given tables as a stream and returns what it wrote."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from maskwork.catalog.base import DOCUMENTS_SQL, EVENTS_SQL, PARTS_SQL, Catalog, events, suffix_sql
from maskwork.catalog.detect import FINDINGS, findings_sql
from maskwork.catalog.redact import tier1
from maskwork.catalog.traffic import AUDIT, BUCKET, BUDGET, LIMITS, RATE, STORM, Derived, _budget_sql, _storm_sql, _token_bucket_sql
from maskwork.operators import joins as J
from maskwork.operators import metrics as A
from maskwork.operators.ordering import assemble_text
from maskwork.session import materialise, prepare, shared_dir
from maskwork.sources.corpus import read_table
from maskwork.streaming import flows, state, timed
from maskwork.streaming.run import read_stream, run_complete, run_to_table, run_updates

FILE_ROWS = 250_000
FILE_BYTES = 16 << 20


def _files(df, n: int) -> int:
    """How many files each of ``n`` slices takes, by rows and by bytes of text."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, StringType)]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0)).cast("bigint")), F.lit(0))).first()
    return max(1, -(-rows // (n * FILE_ROWS)), -(-size // (n * FILE_BYTES)))


def _write_slices(s, slices: list[DataFrame], files: int, path: str) -> None:
    """Each slice as exactly ``files`` files, one slice after another, because a file stream takes files by age."""
    place = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for i, rows in enumerate(slices, 1):
        rows.repartition(files).write.mode("append").parquet(path)
        # a task without rows writes no file
        written = sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(place))
        for _ in range(i * files - written):
            rows.limit(0).write.mode("append").parquet(path)


def sliced(s, df, name: str, order, n: int = 4, after=None) -> Callable[[], DataFrame]:
    """The whole table as a stream of ``n`` micro-batches in the order of a column; each call starts it anew.

    The table is ranged by that column into as many parts as its rows and texts need; each slice is a row of parts, so
    no task takes a whole slice. ``after`` is one more batch, for what moves the watermark beyond the last row.
    """
    path, ranged = shared_dir(s, name), shared_dir(s, name)
    files = _files(df, n)
    df.repartitionByRange(n * files, order).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(ranged)
    kept = s.read.schema(StructType([*df.schema, StructField("__part", IntegerType())])).parquet(ranged)
    _write_slices(s, [kept.where(F.floor(F.col("__part") / files) == i).drop("__part") for i in range(n)], files, path)
    if after is not None:
        after.select(*df.columns).write.mode("append").parquet(path)
    return lambda: read_stream(s, path, files)


def sliced_alike(s, tables: dict, order: str, after: dict, n: int = 4) -> list[DataFrame]:
    """Several tables as streams of ``n`` micro-batches cut at the same values of a column, in the order of that column.

    Cut each by itself, one stream would run ahead of another, and with it the watermark that they share.
    """
    first, *rest = [df.select(order) for df in tables.values()]
    both = reduce(DataFrame.union, rest, first)
    at = F.coalesce(F.unix_micros(order), F.lit(-1 << 62))  # rows without a time come first
    _, *inner = both.agg(F.percentile_approx(at, [i / n for i in range(n)], 10_000)).first()[0] or [0] * n
    out = []
    for name, df in tables.items():
        path, files = shared_dir(s, name), _files(df, n)
        edges = [None, *inner, None]
        cut = [df.where((F.lit(True) if lo is None else at >= lo) & (F.lit(True) if hi is None else at < hi)) for lo, hi in zip(edges, edges[1:])]
        _write_slices(s, cut, files, path)
        if name in after:
            after[name].select(*df.columns).write.mode("append").parquet(path)
        out.append(read_stream(s, path, files))
    return out


def sliced_stream(s, d, name: str, order: str):
    return sliced(s, read_table(prepare(s), d, name), name, order)()


def _with_us(df):
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def event_stream(s, d):
    return _with_us(sliced_stream(s, d, "events", "ts"))


def derived(spec: Derived, s, d):
    return event_stream(s, d).filter(spec.where).selectExpr(*spec.cols)


CHUNKS = Derived(
    "user_id as stream", "event_id as seq", "event_type as delta",
    "case when event_id % 97 = 0 then 'provider' end as err",
)


def register(c: Catalog) -> None:
    c.add("stream_token_bucket",
          lambda s, d: run_to_table(state.token_bucket_stream(derived(RATE, s, d), "user_id", "us", "event_id", *BUCKET), "bucket"),
          _token_bucket_sql(*BUCKET))
    c.add(
        "stream_token_bucket_pruned",
        lambda s, d: run_to_table(state.token_bucket_stream(
            derived(RATE, s, d).withColumn("at", F.timestamp_micros("us")).withWatermark("at", "1 hour"),
            "user_id", "us", "event_id", *BUCKET, event_time="at", max_idle_ms=6_000_000), "pruned"),
        _token_bucket_sql(*BUCKET),
    )
    c.add("stream_fold_storms",
          lambda s, d: run_to_table(state.fold_storms_stream(derived(STORM, s, d), "key", "us", "event_id"), "storm"),
          _storm_sql(10_000_000))
    c.add("stream_daily_budget",
          lambda s, d: run_to_table(state.daily_budget_stream(derived(BUDGET, s, d), LIMITS.df(s, d), "budget_ref", "us", "event_id"), "budget"),
          _budget_sql())
    c.add(
        "stream_optout",
        lambda s, d: run_to_table(state.optout_stream(
            event_stream(s, d).withColumn("is_grant", F.col("event_type") == "signup"), "user_id", "us", "event_id", "is_grant", 6 * J.GRANT_TTL_US), "optout"),
        f"select user_id, us, event_id, exists (select 1 from {EVENTS_SQL} g where g.event_type = 'signup' and g.user_id = r.user_id and g.us <= r.us and g.us >= r.us - 21600000000) as opted_out "
        f"from {EVENTS_SQL} r where event_type <> 'signup'",
    )
    cut_sql = (
        f"select stream, seq, delta, err from (select *, min(case when err is not null then seq end) over (partition by stream) as ending from {CHUNKS.sql}) where ending is null or seq <= ending"
    )
    c.add("cut_on_error", lambda s, d: state.cut_on_error(CHUNKS.df(s, d), "stream", "seq", "err"), cut_sql)
    c.add("stream_cut_on_error",
          lambda s, d: run_to_table(state.cut_on_error_stream(derived(CHUNKS, s, d), "stream", "seq", "delta", "err"), "cut"), cut_sql)
    def redacted_stream(s, d):
        """The redacted chat turns as a stream of chunks beside the vault that made them."""
        redacted, _, vault = tier1(s, d)
        return sliced(s, redacted.select("request_id", "msg_idx", "session_id", "text"), "chunks", "request_id")(), vault

    def restored(s, d):
        chunks, vault = redacted_stream(s, d)
        return flows.restore_stream(chunks, ["request_id", "msg_idx"], "session_id", "text", materialise(vault, "vault"))

    c.add("stream_restore", lambda s, d: restored(s, d).select("request_id", "msg_idx", "text"),
          f"select request_id, msg_idx, text from {PARTS_SQL}")

    def split_chunks(s, d):
        """Each redacted text cut in two at its middle, which breaks some tokens."""
        redacted, _, vault = tier1(s, d)
        two = redacted.withColumn("piece", F.explode(F.array(
            F.struct(F.lit(0).alias("o"), F.expr("left(text, cast(length(text) / 2 as int))").alias("t")),
            F.struct(F.lit(1).alias("o"), F.expr("substring(text, cast(length(text) / 2 as int) + 1)").alias("t")))))
        chunks = two.select("request_id", "session_id", (F.col("msg_idx") * 2 + F.col("piece.o")).alias("seq"), F.col("piece.t").alias("delta"))
        return flows.restore_assembled(chunks, "request_id", "session_id", "seq", "delta", vault)

    c.add("restore_assembled", lambda s, d: split_chunks(s, d).select("request_id", "block", F.col("delta").alias("text")),
          f"select request_id, cast(0 as bigint) as block, string_agg(text, '' order by msg_idx) as text from {PARTS_SQL} group by 1")

    def document_stream(s, d):
        df = sliced_stream(s, d, "documents", F.floor(F.col("doc_id") / 3))  # versions of a document in one batch
        return df.select("doc_id", "source", "n_chars", F.expr(f"text || {suffix_sql('doc_id', True)}").alias("text"))

    c.add("stream_scan", lambda s, d: run_to_table(flows.scan_stream(document_stream(s, d), ["doc_id"], "text"), "scan"),
          f"select * from {FINDINGS}")
    # Documents of one group stand for versions of one document; the highest id is the newest.
    newest = f"(select doc_id, text from (select *, row_number() over (partition by doc_id // 3 order by doc_id desc) as rn from {DOCUMENTS_SQL}) where rn = 1)"
    c.add(
        "stream_rescan",
        lambda s, d: flows.continuous_scan(
            document_stream(s, d).select(F.floor(F.col("doc_id") / 3).alias("doc"), F.col("doc_id").alias("version"), "text"), "doc", "version", "text"
        ).select("doc", "version", "seq", "kind", "start", "end"),
        f"select doc_id // 3 as doc, doc_id as version, seq, kind, start, \"end\" from {findings_sql(newest, 'doc_id')}",
    )
    _register_timed(c)
    c.add(
        "stream_window_counts",
        lambda s, d: run_updates(flows.window_counts(
            event_stream(s, d).withColumn("at", F.timestamp_micros("us")), "at", ["event_type"]), "windows", ["window_start", "event_type"]
        ).select(F.unix_micros("window_start").alias("window_us"), "event_type", "n"),
        f"select us // 600000000 * 600000000 as window_us, event_type, count(*) as n from {EVENTS_SQL} group by 1, 2",
    )
    c.add(
        "window_counts",
        lambda s, d: flows.window_counts(events(s, d).withColumn("at", F.timestamp_micros("us")), "at", ["event_type"])
        .select(F.unix_micros("window_start").alias("window_us"), "event_type", "n"),
        f"select us // 600000000 * 600000000 as window_us, event_type, count(*) as n from {EVENTS_SQL} group by 1, 2",
    )
    c.add(
        "stream_live_totals",
        lambda s, d: run_complete(flows.live_totals(derived(AUDIT, s, d)), "totals"),
        "select count(*) as total, " + ", ".join(f"count(*) filter (where verdict = '{v}') as {v}" for v in A.VERDICTS) + f" from {AUDIT.sql}",
    )
    c.add(
        "stream_live_board",
        lambda s, d: flows.live_board(derived(AUDIT, s, d).select("request_id", "us", "verdict"), "us", "request_id"),
        f"select request_id, us, verdict from {AUDIT.sql} order by us desc, request_id desc limit 8",
    )


TTL_US = 6 * J.GRANT_TTL_US
# Event time of a document's versions: some follow within half a second, some do not.
VERSION_MS = "1700000000000 + doc_id * 40 + doc_id % 3 * (case when doc_id % 2 = 0 then 200 else 900 end)"


def _ending(df, at: str, **values):
    """One row a day after the newest one, which takes the watermark past all others; what is not given is NULL."""
    last = df.agg(F.max(at).alias("__at")).select((F.col("__at") + F.expr("interval 1 day")).alias("__at"))
    kinds = dict(df.dtypes)
    return last.select(*[F.col("__at").alias(n) if n == at else F.lit(values.get(n)).cast(kinds[n]).alias(n) for n in df.columns])


def optout_two_streams(s, d):
    """Grants and requests of the event log as two streams; the last batch holds only the row that ends it."""
    log = _with_us(read_table(prepare(s), d, "events")).select(
        "event_id", "user_id", "us", "event_type", F.timestamp_micros("us").alias("at"))
    start = sliced(s, log, "log", "at", after=_ending(log, "at", event_type="end"))
    requests = start().where("event_type <> 'signup'").drop("event_type")
    grants = start().where("event_type in ('signup', 'end')").select("user_id", "at")
    flagged = timed.optout_join(requests, grants, "user_id", "at", "event_id", TTL_US)
    return run_to_table(flagged.where("event_id is not null").select("event_id", "opted_out"), "optout_join")


def _versions(s, d):
    docs = read_table(prepare(s), d, "documents")
    return docs.select(
        F.floor(F.col("doc_id") / 3).alias("doc"), F.col("doc_id").alias("version"), F.expr(f"text || {suffix_sql('doc_id', True)}").alias("text"),
        F.expr(VERSION_MS).alias("ms"))


def quiet_scan_stream(s, d):
    docs = _versions(s, d).withColumn("at", F.timestamp_millis("ms")).drop("ms")
    stream = sliced(s, docs, "versions", "at", after=_ending(docs, "at", doc=-1, version=-1, text=""))()
    quiet = timed.quiet_stream(stream, "doc", "version", "at", "text")
    found = flows.scan_stream(quiet, ["doc", "version"], "text")
    return run_to_table(found.select("doc", "version", "seq", "kind", "start", "end"), "quiet_scan")


def restored_with_vault(s, d):
    """Redacted turns in pieces that break tokens, and the vault as a second stream that comes five seconds later."""
    redacted, _, vault = tier1(s, d)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("session_id"))
    cut = redacted.select("session_id", "request_id", "msg_idx", F.posexplode(F.array(*[
        F.expr(f"substring(text, cast(length(text) * {i} / 3 as int) + 1, cast(length(text) * {i + 1} / 3 as int) - cast(length(text) * {i} / 3 as int))")
        for i in range(3)])).alias("part", "delta"))
    pieces = cut.select("session_id", "request_id", (F.col("msg_idx") * 3 + F.col("part")).cast("bigint").alias("seq"), "delta", at.alias("at"))
    known = vault.select("session_id", "pseudonym", "plaintext", (at + F.expr("interval 5 seconds")).alias("at"))
    pieces, known = materialise(pieces, "pieces"), materialise(known, "vault")
    ending = _ending(pieces, "at", session_id=-1, request_id=-1, seq=0, delta="")
    chunks, rows = sliced_alike(s, {"chunks": pieces, "known": known}, "at", {"chunks": ending})
    out = run_to_table(timed.restore_with_vault(chunks, rows, "session_id", "request_id", "seq", "delta", "at"), "restored")
    ordered = out.withColumn("place", F.col("seq") * 2 + F.col("piece"))
    return assemble_text(ordered.where("session_id >= 0"), "request_id", "place", "delta").select("request_id", F.col("delta").alias("text"))


def _register_timed(c: Catalog) -> None:
    c.add("stream_optout_join", optout_two_streams, c.oracles["optout_requests"])
    quiet = (
        f"(select doc, version, text from (select doc_id // 3 as doc, doc_id as version, text, lead({VERSION_MS}) over w - ({VERSION_MS}) as gap "
        f"from {DOCUMENTS_SQL} window w as (partition by doc_id // 3 order by {VERSION_MS}, doc_id)) where gap is null or gap >= 500)"
    )
    c.add("quiet_versions", lambda s, d: timed.quiet_versions(_versions(s, d), "doc", "version", "ms").select("doc", "version"),
          f"select doc, version from {quiet}")
    found = findings_sql(f"(select version as doc_id, text from {quiet})", "doc_id")
    c.add("stream_quiet_scan", quiet_scan_stream, f'select doc_id // 3 as doc, doc_id as version, seq, kind, start, "end" from {found}')
    c.add("stream_restore_with_vault", restored_with_vault,
          f"select request_id, string_agg(text, '' order by msg_idx) as text from {PARTS_SQL} group by 1")
