"""The whole request path over a request log, ending in a content-free audit table."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.classify import verdict
from maskwork.operators.injection import BUILTIN_RULES, DEFAULT_THRESHOLD, InjectionRule, matched_rules, score_of
from maskwork.operators.joins import resolve_principal
from maskwork.operators.ordering import daily_budget
from maskwork.operators.quality import MODES
from maskwork.operators.redact import MAX_PART_BYTES, TIER1_KINDS, tier1_segments
from maskwork.operators.routing import SHIPPED_POLICIES, Policy, route
from maskwork.session import materialise

# The only columns an audit row may have. Content is not among them.
AUDIT_COLUMNS = (
    "us", "request_id", "tenant_id", "key_id", "endpoint", "mode", "upstream", "model", "verdict",
    "dlp_findings", "injection_score", "injection_rules", "duration_ms", "error",
)


PART_COLUMNS = (
    "n_parts", "n_not_text", "n_large", "text_bytes", "injection_score", "injection_rules",
    "finding_kinds", "warning_kinds", "dlp_blocked",
)


@dataclass(frozen=True)
class GatewayPolicy:
    actions: dict[str, str] = field(default_factory=dict)
    default_action: str = "redact"
    threshold: int = DEFAULT_THRESHOLD
    rules: Sequence[InjectionRule] = BUILTIN_RULES
    policies: Sequence[Policy] = SHIPPED_POLICIES
    max_part_bytes: int = MAX_PART_BYTES


def inspect_parts(parts: DataFrame, request: str, policy: GatewayPolicy) -> DataFrame:
    """One row per request from one pass over its parts.

    Detection and scoring run in the same projection; only counters and first positions go
    through the shuffle, never the texts or a list that grows with the request.
    """
    actions = {k: policy.actions.get(k) or policy.default_action for k in TIER1_KINDS}
    active = [k for k in TIER1_KINDS if actions[k] != "allow"]
    is_text = F.col("modality") == "text"
    scored = F.col("role").isin("user", "tool") & is_text
    text = F.when(is_text, F.col("text")).otherwise("")
    staged = parts.select(
        request, "msg_idx", "modality",
        tier1_segments(text, active).alias("__segs"),
        F.when(scored, F.lower("text")).otherwise("").alias("__low"),
        F.octet_length(text).alias("__bytes"),
    ).withColumn("__rules", matched_rules(F.col("__low"), policy.rules))

    def hits(kind: str) -> Column:
        return F.size(F.filter("__segs", lambda s: F.coalesce(s["kind"] == kind, F.lit(False))))

    staged = staged.select(
        request, "msg_idx", "modality", "__bytes", score_of(F.col("__rules")).alias("__score"),
        F.transform("__rules", lambda r: r["rule_ord"]).alias("__ords"), *[hits(k).alias(f"__k_{k}") for k in active],
    )
    firsts = [
        F.min(F.when(F.array_contains("__ords", i), F.col("msg_idx"))).alias(f"__r{i}") for i in range(len(policy.rules))
    ]
    grouped = staged.groupBy(request).agg(
        F.count("*").alias("n_parts"),
        F.count_if(~F.coalesce(F.col("modality") == "text", F.lit(False))).alias("n_not_text"),
        F.count_if(F.col("__bytes") > policy.max_part_bytes).alias("n_large"),
        F.sum("__bytes").alias("text_bytes"),
        F.sum("__score").alias("injection_score"),
        *[F.sum(f"__k_{k}").alias(f"n_{k}") for k in active],
        *firsts,
    )
    order = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"__r{i}").isNotNull(), F.struct(F.col(f"__r{i}").alias("m"), F.lit(i).alias("o"), F.lit(r.rule_id).alias("id")))
        for i, r in enumerate(policy.rules)
    ])))

    def kinds(wanted: Sequence[str]) -> Column:
        names = [F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in active if actions[k] in wanted]
        if not names:
            return F.array().cast("array<string>")
        return F.array_sort(F.array_compact(F.array(*names)))

    return grouped.select(
        request, "n_parts", "n_not_text", "n_large", "text_bytes", "injection_score",
        F.transform(order, lambda x: x["id"]).alias("injection_rules"),
        kinds(("redact", "block")).alias("finding_kinds"),
        kinds(("warn",)).alias("warning_kinds"),
        (F.size(kinds(("block",))) > 0).alias("dlp_blocked"),
    )


def gateway_audit(
    requests: DataFrame,
    parts: DataFrame,
    principals: DataFrame,
    limits: DataFrame,
    snapshots: DataFrame,
    policy: GatewayPolicy = GatewayPolicy(),
) -> DataFrame:
    """Audit rows with the first failing step as error.

    requests: request_id, us, api_key, endpoint, mode, model, snapshot, send_error, duration_ms.
    parts: request_id, msg_idx, role, modality, text.  principals: key_hash, tenant_id, key_id,
    budget_ref, expiry_us.  limits: budget_ref, daily_requests.  snapshots: snapshot, candidates.

    Budgets count only requests that passed the steps before; later steps only look at
    requests that are still alive, which the precedence of the error column expresses.
    """
    known = resolve_principal(requests, principals, "api_key", "us")
    auth_ok = F.col("auth_status") == "ok"
    seen = known.join(inspect_parts(parts, "request_id", policy), "request_id", "left")
    mode_ok = F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    early = (
        F.when(~auth_ok, "auth_failed")
        .when(~mode_ok | (F.coalesce("n_parts", F.lit(0)) == 0), "config_invalid")
    )
    # Written once, without keys or content: the texts are read by one job, and the budget
    # replay and everything after it work on these narrow rows.
    staged = materialise(
        seen.select(
            "request_id", "us", "endpoint", "mode", "model", "snapshot", "send_error", "duration_ms",
            "tenant_id", "key_id", "budget_ref", *PART_COLUMNS, early.alias("__early"),
        ),
        "gateway",
    )
    spent = daily_budget(
        staged.filter(F.col("__early").isNull()).select("request_id", "us", "budget_ref"), limits, "budget_ref", "us", "request_id"
    ).select("request_id", "allowed")
    checked = staged.join(spent, "request_id", "left")
    routed = route(checked.join(snapshots, "snapshot", "left"), policy.policies)
    late = (
        F.when(F.col("__early").isNotNull(), F.col("__early"))
        .when(~F.col("allowed"), "budget_exceeded")
        .when(F.col("n_not_text") > 0, "config_invalid")
        .when(F.col("dlp_blocked"), "dlp_blocked")
        .when(F.col("injection_score") >= policy.threshold, "policy_blocked")
        .when(F.col("n_large") > 0, "config_invalid")
        .when(F.col("route_error").isNotNull(), F.col("route_error"))
        .otherwise(F.col("send_error"))
    )
    # Steps that never ran leave nothing in the audit row.
    reached = F.col("__early").isNull() & F.coalesce("allowed", F.lit(False)) & (F.col("n_not_text") == 0)
    ended = routed.withColumn("error", late)
    sent = reached & (F.col("error").isNull() | (F.col("error") == F.col("send_error")))
    none = F.array().cast("array<string>")
    scanned = reached & (F.col("error").isNull() | (F.col("error") != "dlp_blocked"))
    return ended.select(
        "us", "request_id", "tenant_id", "key_id", "endpoint", "mode",
        F.when(sent, F.col("upstream")).alias("upstream"),
        F.when(sent, F.col("model")).alias("model"),
        verdict(F.col("error"), F.size("finding_kinds") > 0, F.size("warning_kinds") > 0).alias("verdict"),
        F.when(scanned, F.col("finding_kinds")).otherwise(none).alias("dlp_findings"),
        F.when(reached, F.col("injection_score")).otherwise(0).cast("int").alias("injection_score"),
        F.when(reached, F.col("injection_rules")).otherwise(none).alias("injection_rules"),
        "duration_ms", "error",
    ).select(*AUDIT_COLUMNS)


def write_audit(audit: DataFrame, path: str) -> None:
    """Append audit rows; columns that are not on the list cannot get in."""
    audit.select(*AUDIT_COLUMNS).write.mode("append").parquet(path)
