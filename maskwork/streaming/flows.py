"""Streams made of ordinary operators: scanning, restoring, windows and live totals."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.operators.detect import explode_findings, with_findings
from maskwork.operators.metrics import VERDICTS
from maskwork.operators.ordering import assemble_text, recent
from maskwork.operators.vault import restore
from maskwork.streaming.run import run_batches, run_folded


def restore_stream(chunks: DataFrame, keys: Sequence[str], session: str, text: str, vault: DataFrame) -> DataFrame:
    """Restore pseudonyms chunk by chunk and return the written chunks.

    A token split over two chunks stays as it is; see ``restore_assembled``.
    """
    return run_batches(chunks, "restore", lambda df: restore(df, keys, session, text, vault))


def restore_assembled(chunks: DataFrame, stream: str, session: str, seq: str, text: str, vault: DataFrame) -> DataFrame:
    """Put the chunks of each stream together first, then restore: split tokens are found too."""
    sessions = chunks.groupBy(stream).agg(F.first(session).alias(session))
    whole = assemble_text(chunks, stream, seq, text).join(sessions, stream)
    return restore(whole, [stream, "block"], session, text, vault)


def scan_stream(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Findings of documents as they arrive. Stateless, so nothing is late."""
    scanned = with_findings(docs.select(*keys, F.col(text).alias("__text")), "__text")
    return explode_findings(scanned, keys)


def latest_versions(docs: DataFrame, key: str, version: str) -> DataFrame:
    """Newest version of each document in a batch, in place of waiting for typing to pause."""
    cols = [c for c in docs.columns if c != key]
    newest = docs.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("__d"))
    return newest.select(key, *[F.col(f"__d.{c}").alias(c) for c in cols])


def continuous_scan(docs: DataFrame, key: str, version: str, text: str) -> DataFrame:
    """Rescan of new and changed documents: per micro-batch the newest version of each."""
    return run_batches(
        docs, "rescan", lambda df: scan_stream(latest_versions(df, key, version), [key, version], text)
    )


def window_counts(
    events: DataFrame, ts: str, dims: Sequence[str], window: str = "10 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Counts per tumbling window; a window is final once the watermark passed its end."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    counted = source.groupBy(F.window(ts, window), *dims).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *dims, "n")


def live_totals(audit: DataFrame) -> DataFrame:
    """Running verdict totals, for complete mode."""
    v = F.col("verdict")
    return audit.groupBy().agg(
        F.count("*").alias("total"), *[F.count_if(v == name).alias(name) for name in VERDICTS]
    )


def live_board(audit: DataFrame, ts: str, tie: str, n: int = 8) -> DataFrame:
    """The one board after the last micro-batch: the newest n entries of all batches so far."""
    return run_folded(audit, "board", lambda board, df: recent(df if board is None else board.unionByName(df), ts, tie, n))
