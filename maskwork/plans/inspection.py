"""The inspection path: raw request bodies in, redacted bodies and audit rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.functions.classify import extract_model, is_chat_endpoint
from maskwork.functions.kinds import tier
from maskwork.operators.bodies import body_findings, body_texts, redact_json_bodies
from maskwork.operators.redact import resolve_action_layered, turn_stats, with_turn_stats


def inspect_findings(bodies: DataFrame, prefs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, findings with actions) of the chat bodies.

    bodies: request_id, path, body, opted_out.  Other paths are never parsed.
    """
    chat = bodies.filter(is_chat_endpoint(F.col("path")))
    texts = body_texts(chat, "request_id", "body")
    acted = resolve_action_layered(body_findings(texts, "request_id"), prefs, rules)
    flags = chat.select("request_id", "opted_out").filter(F.col("opted_out"))
    skipped = acted.join(flags, "request_id", "left").withColumn(
        "action",
        F.when(F.coalesce("opted_out", F.lit(False)) & (tier(F.col("kind")) == "high"), "skip").otherwise(F.col("action")),
    )
    return texts, skipped.drop("opted_out")


def inspect_audit(bodies: DataFrame, prefs: DataFrame, rules: DataFrame) -> DataFrame:
    """One content-free row per chat request: kinds, counters and verdict.

    Statistics and blocking look at the newest user message only.
    """
    _, found = inspect_findings(bodies, prefs, rules)
    # seq counts within a text; put the block in front so the first finding is the first block's.
    placed = found.filter("is_last").withColumn("seq", F.struct("blk_idx", "seq"))
    chat = bodies.filter(is_chat_endpoint(F.col("path"))).select(
        "request_id", F.col("path").alias("endpoint"), extract_model(F.col("body")).alias("model")
    )
    rows = with_turn_stats(chat, turn_stats(placed, "request_id"), "request_id")
    blocked = F.col("block_kind") != ""
    changed = F.col("n_one_way") + F.col("n_tokenized") > 0
    # A blocked request records the blocking kind alone.
    kinds = F.when(blocked, F.col("block_kind")).otherwise(F.regexp_replace("kinds", "=[0-9]+", ""))
    return rows.select(
        "request_id", "endpoint", "model", kinds.alias("dlp_findings"), "kinds", "notify_kind", "block_kind",
        "n_one_way", "n_tokenized", "n_allowed", "n_skipped",
        F.when(blocked, "blocked_dlp").when(changed, "redacted").otherwise("allowed").alias("verdict"),
    )


def inspect_bodies(bodies: DataFrame, prefs: DataFrame, rules: DataFrame, salt: str) -> DataFrame:
    """request_id, body: chat bodies redacted, all others as they were."""
    _, found = inspect_findings(bodies, prefs, rules)
    found = found.persist()  # read by the numbering, the masks and the pairs
    return redact_json_bodies(bodies.select("request_id", "body"), "request_id", "body", found, salt)
