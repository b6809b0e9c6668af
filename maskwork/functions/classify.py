"""Outcome maps, request classification and small parsers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwork.functions.kinds import choose

# --- outcomes ---------------------------------------------------------------------------
# Error classes and what they map to. NULL stands for no error.


def verdict(error: Column, had_findings: Column, had_warnings: Column) -> Column:
    return (
        F.when(error.isNull() & had_findings, "redacted")
        .when(error.isNull() & had_warnings, "warned")
        .when(error.isNull(), "allowed")
        .when(error == "dlp_blocked", "blocked_dlp")
        .when(error.isin("policy_blocked", "dlp_redaction"), "blocked_policy")
        .when(error == "auth_failed", "auth_failed")
        .when(error.isin("unavailable", "provider", "rate_limit"), "upstream_error")
        .otherwise("error")
    )


def outcome(error: Column) -> Column:
    return (
        F.when(error.isNull(), "success")
        .when(error == "client_abort", "client_error")
        .when(error.isin("policy_blocked", "dlp_redaction"), "policy_blocked")
        .when(error.isin("rate_limit", "unavailable", "provider"), "upstream_error")
        .otherwise("unknown")
    )


def http_status(error: Column) -> Column:
    """A finding block has no status of its own here and falls to 500."""
    return (
        F.when(error.isNull(), 200)
        .when(error == "auth_failed", 401)
        .when(error.isin("policy_blocked", "dlp_redaction"), 403)
        .when(error == "budget_exceeded", 402)
        .when(error == "rate_limit", 429)
        .when(error.isin("unavailable", "provider"), 502)
        .when(error.isin("config_invalid", "cap_mismatch"), 400)
        .when(error == "client_abort", 499)
        .otherwise(500)
    )


def error_type(error: Column) -> Column:
    """Error type in responses of the first wire shape."""
    table = {
        "auth_failed": "unauthorized",
        "policy_blocked": "policy_blocked",
        "budget_exceeded": "budget_exceeded",
        "rate_limit": "rate_limit",
        "unavailable": "upstream_unavailable",
        "provider": "provider_error",
    }
    return F.when(error.isNotNull(), choose(error, table, F.lit("internal")))


def message_error_type(error: Column) -> Column:
    """Error type in responses of the messages wire shape."""
    table = {
        "auth_failed": "authentication_error",
        "policy_blocked": "permission_error",
        "dlp_redaction": "permission_error",
        "dlp_blocked": "permission_error",
        "budget_exceeded": "billing_error",
        "rate_limit": "rate_limit_error",
        "unavailable": "overloaded_error",
        "provider": "overloaded_error",
        "config_invalid": "invalid_request_error",
        "cap_mismatch": "invalid_request_error",
    }
    return F.when(error.isNotNull(), choose(error, table, F.lit("api_error")))


def send_outcome(status: Column, net_error: Column) -> Column:
    """Error class of one upstream send; ``net_error`` is NULL, 'abort' or any other failure."""
    return (
        F.when(net_error == "abort", "client_abort")
        .when(net_error.isNotNull(), "unavailable")
        .when(status == 429, "rate_limit")
        .when(status >= 500, "unavailable")
        .when(status >= 400, "provider")
    )


def send_failed(status: Column, net_error: Column) -> Column:
    """Whether a send counts against the upstream's health (other 4xx do not)."""
    return net_error.isNotNull() | F.coalesce((status == 429) | (status >= 500), F.lit(False))


FINISH_IN = {"stop": "stop", "length": "length", "tool_calls": "tool_calls", "content_filter": "content_filter"}
STOP_IN = {"end_turn": "stop", "max_tokens": "length", "stop_sequence": "stop", "tool_use": "tool_calls"}
STOP_OUT = {"length": "max_tokens", "tool_calls": "tool_use", "stop": "end_turn"}


def finish_reason(raw: Column) -> Column:
    return choose(raw, FINISH_IN, F.lit("unknown"))


def stop_reason_in(raw: Column) -> Column:
    return choose(raw, STOP_IN, F.lit("unknown"))


def stop_reason_out(finish: Column) -> Column:
    return choose(finish, STOP_OUT, F.lit("end_turn"))


def verdict_short(v: Column) -> Column:
    table = {
        "allowed": "ALLOW",
        "redacted": "REDACT",
        "warned": "WARN",
        "blocked_dlp": "BLOCK",
        "blocked_policy": "BLOCK",
        "upstream_error": "ERROR",
        "auth_failed": "AUTH",
    }
    return choose(v, table, v)


def err_class(error: Column) -> Column:
    return F.when(error.isin("canceled", "deadline"), error).otherwise("other")


def forward_error_level(error: Column) -> Column:
    return F.when(err_class(error) == "other", "warn").otherwise("debug")


# --- requests ---------------------------------------------------------------------------

CHAT_PREFIXES = ("/v1/messages", "/v1/chat/completions", "/v1/completions", "/v1/responses")
_GO_SPACE = " \t\n\x0b\f\r\x85\xa0"


def trim_space(text: Column) -> Column:
    """Trim white space of both ends."""
    return F.btrim(text, F.lit(_GO_SPACE))


def parse_role(role: Column) -> Column:
    return F.when(role.isin("system", "assistant", "tool"), role).otherwise("user")


def parse_answer(text: Column) -> Column:
    t = F.lower(trim_space(text))
    return (
        F.when(t.isin("y", "yes"), "yes")
        .when(t.isin("n", "no"), "no")
        .when(t.isin("session", "disable", "disable safety", "disable checks"), "session")
        .otherwise("none")
    )


def coarse_path(path: Column) -> Column:
    """First two non-empty segments among the first three pieces."""
    pieces = F.split(F.regexp_replace(path, "^/", ""), "/", 3)
    kept = F.slice(F.filter(pieces, lambda x: x != ""), 1, 2)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def is_chat_endpoint(path: Column) -> Column:
    low = F.lower(path)
    hit = F.lit(False)
    for p in CHAT_PREFIXES:
        hit = hit | low.startswith(p)
    return hit


def host_of(url: Column) -> Column:
    """Host of a URL without port; empty where there is no scheme."""
    return F.when(
        F.contains(url, F.lit("://")),
        F.regexp_replace(F.substring_index(F.regexp_replace(url, r"^.*?://", ""), "://", 1000000), r"(?s)[/?#:].*$", ""),
    ).otherwise("")


def host_only(hostport: Column) -> Column:
    """host:port -> host; anything else unchanged."""
    return F.when(F.rlike(hostport, F.lit(r"^[^:\[\]]*:[^:]*$")), F.substring_index(hostport, ":", 1)).otherwise(hostport)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def scheme_status(url: Column, allowed: tuple[str, ...] = ("https",)) -> Column:
    s = url_scheme(url)
    return F.when(s == "", "missing").when(s.isin(*allowed), "ok").otherwise("blocked")


def session_key(auth: Column, api_key: Column) -> Column:
    """Hash of the first 128 bytes of both headers; empty if both are."""
    a, k = F.coalesce(auth, F.lit("")), F.coalesce(api_key, F.lit(""))

    def head(x: Column) -> Column:
        return F.substring(x.cast("binary"), 1, 128)

    joined = F.concat(head(a), F.unhex(F.lit("00")), head(k))
    return F.when((a == "") & (k == ""), "").otherwise(F.sha2(joined, 256))


def extract_bearer(header: Column) -> Column:
    h = F.coalesce(header, F.lit(""))
    return F.when(F.lower(F.substring(h, 1, 7)) == "bearer ", trim_space(F.substr(h, F.lit(8)))).otherwise("")


def request_key(auth: Column, api_key: Column) -> Column:
    """The bearer token, else the api-key header, else empty."""
    return F.coalesce(F.nullif(extract_bearer(auth), F.lit("")), api_key, F.lit(""))


def extract_model(body: Column) -> Column:
    doc = F.try_parse_json(body)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.model", "variant"))
    model = F.when(kind == "STRING", F.try_variant_get(doc, "$.model", "string"))
    return trim_space(F.coalesce(model, F.lit("")))


def wants_stream(body: Column) -> Column:
    doc = F.try_parse_json(body)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.stream", "variant"))
    return F.coalesce(F.when(kind == "BOOLEAN", F.try_variant_get(doc, "$.stream", "boolean")), F.lit(False))


def fill_id(given: Column, *seed: Column) -> Column:
    """The id given, else 16 hex characters that depend only on the row."""
    made = F.substring(F.sha2(F.concat_ws("|", *[s.cast("string") for s in seed]), 256), 1, 16)
    return F.coalesce(F.nullif(given, F.lit("")), made)


def humanize_duration(seconds: Column) -> Column:
    h = F.floor(seconds / 3600).cast("bigint")
    m = F.floor(seconds / 60).cast("bigint") - h * 60

    def s(c: Column) -> Column:
        return c.cast("string")

    return (
        F.when(seconds <= 0, "0m")
        .when(h >= 24, F.concat(s(F.floor(h / 24).cast("bigint")), F.lit("d "), s(h % 24), F.lit("h")))
        .when(h > 0, F.concat(s(h), F.lit("h "), s(m), F.lit("m")))
        .otherwise(F.concat(s(m), F.lit("m")))
    )


def retry_after_text(seconds: Column) -> Column:
    """Whole seconds for display, at least 1; halves round to even."""
    return F.when(seconds < 1, "1").otherwise(F.bround(seconds, 0).cast("bigint").cast("string"))


def supports_streaming(streaming: Column) -> Column:
    return F.coalesce(streaming.isin("sse", "ws"), F.lit(False))
