"""Stream operators whose answers depend on the watermark: an interval join, a debounce and a restore with late vault rows.

What the watermark passes leaves the state, so state is bounded by the interval and not by the stream. Rows that
are not newer than the newest one less ``late`` are dropped as late; Spark counts them in ``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwork.functions.patterns import PSEUDONYM
from maskwork.operators.joins import GRANT_TTL_US
from maskwork.operators.ranking import sliced_previous
from maskwork.streaming.state import move_timer

QUIET_MS = 500
_NEVER = -(1 << 62)  # time of a request without one, and of a grant that is not there
_ROWS = pa.schema([("s", pa.string()), ("us", pa.int64()), ("row", pa.string())])
_NO_ROWS = _ROWS.empty_table().to_pandas()
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_JSON = {"timestampFormat": f"{_MICROS}XXX", "timestampNTZFormat": _MICROS}
# Any proper beginning of a pseudonym; one never holds a second bracket.
_UNFINISHED = re.compile(r"\[(?:[A-Z_]*|[A-Z_]+_[0-9]+|[A-Z_]+_[0-9]+_[A-Za-z0-9_\-]*)\Z")
_TOKEN = re.compile(PSEUDONYM, re.ASCII)


class _Optout(StatefulProcessor):
    """Requests and grants of the sessions of one group: one call and one timer serve many sessions.

    The state holds Arrow tables: the requests that wait, and the grants that still count.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "waiting binary, given binary")

    def _held(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if not self.state.exists():
            return _NO_ROWS, _NO_ROWS
        return tuple(pa.ipc.open_stream(bytes(b)).read_all().to_pandas() for b in self.state.get())

    def _due(self, waiting: pd.DataFrame, given: pd.DataFrame) -> int | None:
        """When the oldest waiting request, or else the newest grant, has lost its meaning."""
        if len(waiting):
            return -(-int(waiting["us"].min()) // 1000)
        return -(-(int(given["us"].max()) + self.ttl_us) // 1000) if len(given) else None

    def _keep(self, waiting: pd.DataFrame, given: pd.DataFrame) -> None:
        if len(waiting) or len(given):
            self.state.update(tuple(_packed(df) for df in (waiting, given)))
        else:
            self.state.clear()

    def _after(self, given: pd.DataFrame, now_us: int) -> pd.DataFrame:
        """Grants for requests newer than the watermark: of a session's older ones only the newest can count."""
        given = given[given["s"].notna() & (given["us"] + self.ttl_us > now_us)].sort_values("us")
        past = given["us"] <= now_us
        return pd.concat([given[past].drop_duplicates("s", keep="last"), given[~past].drop_duplicates(["s", "us"])], ignore_index=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        waiting, given = self._held()
        before = self._due(waiting, given)
        new = pd.concat([df[["s", "us", "row"]] for df in rows], ignore_index=True)
        asked = new["row"].notna()
        given = pd.concat([given, new[~asked]], ignore_index=True).sort_values("us")
        waiting = pd.concat([waiting, new[asked]], ignore_index=True).sort_values("us", ignore_index=True)
        # the newest grant up to the request decides
        last = _latest(waiting, given)
        hit = (last != _NEVER) & (waiting["us"].to_numpy(np.int64) - last <= self.ttl_us)
        # without a session or a time no grant ever comes
        done = hit | waiting["s"].isna().to_numpy() | (waiting["us"].to_numpy(np.int64) == _NEVER)
        out = pd.DataFrame({"row": waiting["row"][done], "opted_out": hit[done]})
        waiting = waiting[~done]
        # requests that wait know the grants there are, so only newer ones count for them
        given = self._after(given, timerValues.getCurrentWatermarkInMs() * 1000)
        due = self._due(waiting, given)
        if due is None:
            if before is not None:
                self.handle.deleteTimer(before)
        else:
            move_timer(self.handle, before, due)
        self._keep(waiting, given)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        waiting, given = self._held()
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        past = waiting["us"].to_numpy(np.int64) <= now_us
        rest, given = waiting[~past], self._after(given, now_us)
        due = self._due(rest, given)
        if due is not None:
            self.handle.registerTimer(due)
        self._keep(rest, given)
        yield pd.DataFrame({"row": waiting["row"][past], "opted_out": False})

    def close(self) -> None:
        pass


def _packed(df: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(df, _ROWS, preserve_index=False)
    with pa.ipc.new_stream(out, _ROWS) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _latest(asked: pd.DataFrame, given: pd.DataFrame) -> np.ndarray:
    """Time of the session's newest grant up to each request, far in the past if there is none. Both come in order of time."""
    codes, _ = pd.factorize(pd.concat([asked["s"], given["s"]], ignore_index=True))
    left = pd.DataFrame({"us": asked["us"].to_numpy(np.int64), "s": codes[:len(asked)]})
    right = pd.DataFrame({"us": given["us"].to_numpy(np.int64), "s": codes[len(asked):], "last": np.arange(len(given))})
    at = pd.merge_asof(left, right[right["s"] >= 0], on="us", by="s")["last"].fillna(-1).to_numpy(np.int64)
    return np.append(right["us"].to_numpy(), _NEVER)[at]


def optout_join(
    requests: DataFrame, grants: DataFrame, session: str, at: str, tie: str, ttl_us: int = GRANT_TTL_US, late: str = "0 seconds",
    groups: int = 1024
) -> DataFrame:
    """Requests with ``opted_out``: ``with_optout`` over two streams, grants and requests.

    ``at`` is a timestamp in both; ``tie`` tells the requests of a session and time apart. A request with a grant
    within ``ttl_us`` before it comes out as soon as both are there, one without when the watermark has passed it. Grants
    leave the state when the watermark is ``ttl_us`` beyond them. A request looks up the newest grant up to it and no
    pairs are built. Sessions are dealt to ``groups`` by their hash, one call of Python a group and micro-batch.
    """
    asked = requests.withWatermark(at, late).dropDuplicatesWithinWatermark([session, at, tie])
    given = grants.select(F.col(session).alias("__session"), F.col(at).alias("__at")).withWatermark("__at", late)
    us = lambda c: F.coalesce(F.unix_micros(c), F.lit(_NEVER))
    # the request travels as one text: beside missing ones pandas would make whole numbers inexact
    row = F.to_json(F.struct(*requests.columns), _JSON)
    both = asked.select(F.col(session).cast("string").alias("s"), us(at).alias("us"), row.alias("row"), F.col(at).alias("__at")).union(
        given.select(F.col("__session").cast("string"), us("__at"), F.lit(None).cast("string"), "__at"))
    # no filter on the grants: Spark would push it below the watermark, which rows without a session move, too
    dealt = both.withColumn("g", F.pmod(F.xxhash64(F.coalesce("s", "row")), F.lit(groups)))
    out = dealt.groupBy("g").transformWithStateInPandas(_Optout(ttl_us), "row string, opted_out boolean", "Append", "EventTime")
    return out.select(F.from_json("row", requests.schema, _JSON).alias("r"), "opted_out").select("r.*", "opted_out")


def quiet_versions(docs: DataFrame, key: str, version: str, at: str, quiet_ms: int = QUIET_MS, slice_ms: int = 3_600_000) -> DataFrame:
    """Versions of documents that no other one followed within ``quiet_ms``. ``at`` is in milliseconds; at equal times the
    higher version is the later one. A document with very many versions is cut into slices of time."""
    back = docs.withColumn("__back", -F.col(at)).withColumn("__turn", -F.col(version))
    stepped = sliced_previous(back, [key], ["__back", "__turn"], "__back", F.floor(F.col("__back") / slice_ms))
    alone = F.col("previous").isNull() | (F.col("__back") - F.col("previous") >= quiet_ms)
    return stepped.where(alone).drop("__back", "__turn", "previous")


def quiet_stream(docs: DataFrame, key: str, version: str, at: str, text: str, quiet_ms: int = QUIET_MS, late: str = "0 seconds") -> DataFrame:
    """Streaming form of ``quiet_versions``: key, version, ms, text of a version once its document has been quiet for ``quiet_ms``.

    ``at`` is a timestamp and counts in milliseconds. Versions that follow each other sooner are a session, whose last one comes out
    when the watermark has passed its end; until then the state holds one row per session. A version is late when the watermark
    is ``quiet_ms`` beyond it.
    """
    if quiet_ms < 1:
        raise ValueError("quiet_ms must be at least 1")
    rows = docs.select(F.col(key).alias("k"), F.timestamp_millis(F.unix_millis(at)).alias("__at"), F.struct(
        F.unix_millis(at).alias("ms"), F.col(version).alias("version"), F.col(text).alias("text")).alias("v"))
    # a session goes on up to its end itself, so it ends one microsecond early
    session = F.session_window("__at", f"{quiet_ms * 1000 - 1} microseconds")
    last = rows.withWatermark("__at", late).groupBy("k", session).agg(F.max_by("v", F.struct("v.ms", "v.version")).alias("v"))
    return last.select(F.col("k").alias(key), F.col("v.version").alias(version), F.col("v.ms").alias("ms"), F.col("v.text").alias(text))


def unfinished(text: str) -> int:
    """Where a token begins that the end of ``text`` cuts off; the text's length if there is none."""
    at = text.rfind("[")
    return at if at >= 0 and _UNFINISHED.match(text, at) else len(text)


class _Restore(StatefulProcessor):
    def __init__(self, wait_ms: int, keep_ms: int, stream: str):
        self.wait_ms, self.keep_ms, self.stream = wait_ms, max(keep_ms, wait_ms), stream

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vault = handle.getMapState("vault", "pseudonym string", "plaintext string")
        self.carry = handle.getMapState("carry", f"stream {self.stream}", "seq bigint, text string, due bigint")
        self.waiting = handle.getListState("waiting", f"stream {self.stream}, seq bigint, piece int, text string, due bigint")
        self.last = handle.getValueState("last", "ms bigint")

    def _known(self, text: str, found: dict) -> bool:
        """Whether the vault has all tokens of the text; those it has are put into ``found``."""
        whole = True
        for token in set(_TOKEN.findall(text)):
            if token not in found and self.vault.containsKey((token,)):
                found[token] = self.vault.getValue((token,))[0]
            whole &= token in found
        return whole

    def _rows(self, key, pieces: list) -> pd.DataFrame:
        rows = [(key[0], *piece[:4]) for piece in pieces]
        return pd.DataFrame(rows, columns=["k", "stream", "seq", "piece", "text"], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        new = pdf[pdf["pseudonym"].notna()]
        for token, plain in zip(new["pseudonym"], new["plaintext"]):
            self.vault.updateValue((token,), (plain,))
        last = max(int(pdf["ms"].max()), self.last.get()[0] if self.last.exists() else 0)
        self.last.update((last,))
        self.handle.registerTimer(last + self.keep_ms)
        cut = []
        chunks = pdf[pdf["pseudonym"].isna()]
        if chunks["stream"].dtype.kind == "f":  # whole numbers beside the missing ones of the vault's rows
            chunks = chunks.astype({"stream": np.int64})
        for stream, own in chunks.groupby("stream", sort=False):
            at = (stream.item() if hasattr(stream, "item") else stream,)
            held = self.carry.getValue(at)[1] if self.carry.containsKey(at) else ""
            own = own.sort_values("seq")
            for seq, text, ms in zip(own["seq"].tolist(), own["text"].tolist(), own["ms"].tolist()):
                text = held + (text or "")
                stop = unfinished(text)
                cut.append((at[0], int(seq), 0, text[:stop], int(ms) + self.wait_ms))
                held = text[stop:]
            if held:
                due = int(ms) + self.wait_ms
                self.carry.updateValue(at, (int(seq), held, due))
                self.handle.registerTimer(due)
            elif self.carry.containsKey(at):
                self.carry.removeKey(at)
        yield self._settle(key, cut, None)

    def _settle(self, key, cut: list, now: int | None) -> pd.DataFrame:
        """Restore what can be: pieces whose tokens are all known, and those that have waited long enough."""
        before = list(self.waiting.get()) if self.waiting.exists() else []
        found: dict = {}
        done, rest = [], []
        for piece in [*before, *cut]:
            if self._known(piece[3], found) or (now is not None and piece[4] <= now):
                done.append((*piece[:3], _TOKEN.sub(lambda m: found.get(m[0], m[0]), piece[3])))
            else:
                rest.append(tuple(piece))
                self.handle.registerTimer(int(piece[4]))
        if rest:
            self.waiting.put(rest)
        elif before:
            self.waiting.clear()
        return self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        ended = []
        if self.carry.exists():
            for at, (seq, text, due) in list(self.carry.iterator()):
                if due <= now:
                    ended.append((at[0], seq, 1, text, due))
                    self.carry.removeKey(at)
        out = self._settle(key, ended, now)
        if self.last.exists() and self.last.get()[0] + self.keep_ms <= now:
            for state in (self.vault, self.carry, self.waiting, self.last):
                state.clear()
        yield out

    def close(self) -> None:
        pass


def restore_with_vault(
    chunks: DataFrame, vault: DataFrame, session: str, stream: str, seq: str, text: str, at: str, wait_ms: int = 60_000,
    keep_ms: int = 3_600_000, late: str = "0 seconds"
) -> DataFrame:
    """Restore pseudonyms in chunks while the vault's rows (session, pseudonym, plaintext, at) arrive as a stream, too.

    Gives session, stream, seq, piece, text. A token that a chunk's end cuts off is held back and goes on in front of the
    stream's next chunk, so joined in the order of seq and piece the texts are those of ``restore_assembled``. A
    piece with a token that the vault does not know yet waits for it until the watermark is ``wait_ms`` beyond
    the chunk, then it comes out with the token in it; so does a cut token without a next chunk, as piece 1. A session whose
    last row lies ``keep_ms`` behind the watermark is dropped with its vault rows. All rows of a session are one key, and
    chunks of a stream come in the order of seq.
    """
    none = lambda kind: F.lit(None).cast(kind)
    types = dict(chunks.dtypes)
    pieces = chunks.select(
        F.col(session).alias("k"), F.col(stream).alias("stream"), F.col(seq).cast("bigint").alias("seq"), F.col(text).alias("text"),
        none("string").alias("pseudonym"), none("string").alias("plaintext"), F.col(at).alias("at"))
    known = vault.select(
        F.col(session).alias("k"), none(types[stream]).alias("stream"), none("bigint").alias("seq"), none("string").alias("text"),
        "pseudonym", "plaintext", F.col(at).alias("at"))
    # one watermark over both, so that a quiet vault does not hold the chunks up
    both = pieces.union(known).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    out = both.groupBy("k").transformWithStateInPandas(
        _Restore(wait_ms, keep_ms, types[stream]), f"k {types[session]}, stream {types[stream]}, seq bigint, piece int, text string",
        "Append", "EventTime")
    return out.withColumnsRenamed({"k": session, "stream": stream, "seq": seq, "text": text})
