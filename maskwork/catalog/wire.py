"""Queries on stored bodies, event streams, responses and the composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwork.catalog.base import DOCUMENTS_SQL, PARTS_SQL, Catalog, documents, parts
from maskwork.catalog.chat import MODAL_SQL, TURNS_SQL, attack_sql, matches_sql, modal, turns
from maskwork.catalog.detect import FINDINGS, findings_sql
from maskwork.catalog.redact import DEFAULT_SQL, ONE_WAY_SQL, TIER_SQL, SALT, pseudonym_sql, tier1_sql
from maskwork.catalog.traffic import AUDIT, SENDS, SQL_FAILED, Derived, pick
from maskwork.functions import classify as C
from maskwork.operators import routing as R
from maskwork.operators import stages as X
from maskwork.plans import corpus, gateway, inspection
from maskwork.session import prepare
from maskwork.sources import wire
from maskwork.sources.corpus import read_table

# Chat text without the characters JSON has to escape, read alike by both engines.
CLEAN = "translate(text, '\"' || chr(92) || chr(10) || chr(13) || chr(9), '     ')"
CLEAN_PARTS = Derived(
    "request_id * 100 + msg_idx as request_id", "request_id * 7 + msg_idx as i", "role", f"{CLEAN} as text",
    source=lambda s, d: parts(s, d), source_sql=PARTS_SQL,
)
_U = "'{\"role\":\"' || role || '\",\"content\":'"
_HEAD = "'{\"model\":\"m' || cast(i % 5 as string) || '\",'"
_SYS = "'{\"role\":\"system\",\"content\":\"Be brief.\"},'"
BODY = (
    "case i % 13 "
    f"when 4 then {_HEAD} || '\"stream\":true,\"messages\":[' || {_U} || '[{{\"type\":\"text\",\"text\":\"' || text || '\"}},{{\"type\":\"text\",\"text\":\" tail\"}}]}}]}}' "
    f"when 5 then {_HEAD} || '\"messages\":[' || {_SYS} || {_U} || '[{{\"type\":\"text\",\"text\":\"x\"}},{{\"type\":\"image\",\"url\":\"u\"}}]}}]}}' "
    f"when 6 then '{{\"messages\":[' || {_U} || '\"' || text || '\"}}]}}' "
    "when 7 then 'not json ' || text "
    f"when 8 then {_HEAD} || '\"messages\":[{{\"role\":\"user\",\"content\":null}},{{\"role\":\"developer\"}}]}}' "
    f"when 9 then {_HEAD} || '\"messages\":[]}}' "
    f"when 10 then {_HEAD} || '\"messages\":[{{\"role\":\"user\",\"content\":7}}]}}' "
    f"when 11 then '{{\"model\":5,\"messages\":[' || {_U} || '\"x\"}}]}}' "
    f"else {_HEAD} || '\"stream\":false,\"max_tokens\":' || cast(i % 3 as string) || ',\"system\":' || case when i % 2 = 0 then '\"Sys\"' else '[{{\"type\":\"text\",\"text\":\"S1\"}}]' end || ',\"messages\":[' || {_SYS} || {_U} || '\"' || text || '\"}}]}}' end"
).replace("{{", "{").replace("}}", "}")
BODIES = Derived("request_id", "i", "role", "text", f"{BODY} as body", source=lambda s, d: CLEAN_PARTS.df(s, d), source_sql=CLEAN_PARTS.sql)

BASE_ERR = (
    "case when i % 13 in (7, 11) then 'invalid body' when i % 13 in (6, 9) then 'missing model or messages' {mid} "
    "when i % 13 = 5 then 'message[1]: unsupported content part type' when i % 13 = 10 then 'message[0]: content must be a string or array of text parts' end"
)
# What each body must yield, stated from how it was made.
ROLE = "case when role in ('system', 'assistant', 'tool') then role else 'user' end"


def expected(shape: str) -> str:
    ant = shape == "anthropic"
    mid = "when i % 13 in (4, 5, 8, 10) or i % 3 = 0 then 'max_tokens is required and must be > 0'" if ant else ""
    return f"(select *, {BASE_ERR.format(mid=mid)} as error from {CLEAN_PARTS.sql})"


def expected_parts(shape: str) -> str:
    ant = shape == "anthropic"
    sysm = "{'role': 'system', 'text': case when i % 2 = 0 then 'Sys' else 'S1' end}, " if ant else ""
    usual = "[" + sysm + "{'role': 'system', 'text': 'Be brief.'}, {'role': " + ROLE + ", 'text': text}]"
    msgs = (
        "case i % 13 when 4 then [{'role': " + ROLE + ", 'text': text || ' tail'}] when 8 then [{'role': 'user', 'text': ''}, {'role': 'user', 'text': ''}] else "
        + usual + " end"
    )
    return (
        f"(select request_id, cast(g - 1 as integer) as msg_idx, m[g].role as role, 'text' as modality, m[g].text as text from "
        f"(select request_id, {msgs} as m, unnest(range(1, len({msgs}) + 1)) as g from {expected(shape)} where error is null))"
    )


LINES = Derived(
    "request_id as stream", "msg_idx",
    "case msg_idx % 4 when 0 then 'data: {\"choices\":[{\"delta\":{\"content\":\"' || " + CLEAN + " || '\"}}]}' "
    "when 1 then 'data: {\"choices\":[]}' when 2 then ': comment' else 'data: {\"choices\":[{\"delta\":{},\"finish_reason\":\"' || "
    + pick("request_id", ("stop", "length", "odd")) + " || '\"}]}' end as l1",
    "case when request_id % 5 = 0 and msg_idx = 4 then 'data: [DONE]' when request_id % 7 = 0 and msg_idx = 2 then 'data: {broken' else 'event: x' end as l2",
    source=lambda s, d: parts(s, d), source_sql=PARTS_SQL,
)
ANT_LINES = Derived(
    "request_id as stream", "msg_idx",
    "case msg_idx % 4 when 0 then 'data: {\"type\":\"content_block_delta\",\"delta\":{\"type\":\"text_delta\",\"text\":\"' || " + CLEAN + " || '\"}}' "
    "when 1 then 'data: {\"type\":\"ping\"}' when 2 then 'data: {\"type\":\"content_block_delta\",\"delta\":{\"type\":\"text_delta\",\"text\":\"\"}}' "
    "else 'data: {\"type\":\"message_delta\",\"delta\":{\"stop_reason\":\"' || " + pick("request_id", ("end_turn", "max_tokens", "odd")) + " || '\"}}' end as l1",
    "case when request_id % 5 = 0 and msg_idx = 4 then 'data: {\"type\":\"message_stop\"}' when request_id % 7 = 0 and msg_idx = 2 then 'data: {broken' else 'event: x' end as l2",
    source=lambda s, d: parts(s, d), source_sql=PARTS_SQL,
)


def lines(spec, s, d):
    return spec.df(s, d).select("stream", F.expr("stack(2, msg_idx * 2, l1, msg_idx * 2 + 1, l2)").alias("line_no", "line"))


def lines_sql(spec) -> str:
    return (
        f"(select stream, msg_idx * 2 as line_no, l1 as line from {spec.sql} union all select stream, msg_idx * 2 + 1, l2 from {spec.sql})"
    )


def sse_sql(spec, counted: str, stop: str) -> str:
    """Lines up to the end of each stream with the running number of counted events."""
    data = f"(select stream, line_no, substr(line, 7) as p, json_valid(substr(line, 7)) as ok from {lines_sql(spec)} where starts_with(line, 'data: '))"
    marked = f"(select *, case when {stop} then 'stop' when not ok then 'bad' end as e from {data})"
    cut = f"(select *, min(case when e is not null then line_no end) over (partition by stream) as ending from {marked})"
    live = f"(select * from {cut} where ending is null or line_no < ending or (line_no = ending and e = 'bad'))"
    return f"(select *, coalesce(sum(case when e is null and {counted} then 1 else 0 end) over (partition by stream order by line_no), 0)::bigint as seq from {live})"


RESP = Derived(
    "request_id", "i", "text",
    "case i % 6 when 0 then '{\"choices\":[]}' when 1 then 'oops' else '{\"model\":\"m' || cast(i % 3 as string) || '\",\"choices\":[{\"message\":{\"role\":\"assistant\",\"content\":\"' || text || "
    "'\"}},{\"message\":{\"content\":\"b\"}}],\"usage\":{\"prompt_tokens\":' || cast(i as string) || ',\"completion_tokens\":7,\"total_tokens\":' || cast(i + 7 as string) || '}}' end as body",
    "case i % 6 when 1 then '[1]' else '{\"model\":\"m' || cast(i % 3 as string) || '\",\"content\":[{\"type\":\"text\",\"text\":\"' || text || '\"},{\"type\":\"tool_use\"},{\"type\":\"text\",\"text\":\"!\"}],"
    "\"usage\":{\"input_tokens\":' || cast(i as string) || ',\"output_tokens\":3}}' end as abody",
    source=lambda s, d: CLEAN_PARTS.df(s, d), source_sql=CLEAN_PARTS.sql,
)

# --- inspection
class _Inspect(Derived):
    """Chat bodies as JSON texts; both engines write string literals with their own function."""

    _BODY = (
        "case when i % 17 = 3 then 'broken' when i % 17 = 5 then '{\"messages\":[],\"big\":12345678901234567890123456789012345678901234567890, \"messages\" : [{\"content\":\"x\",\"role\":\"user\",\"content\":' || $A || '}]}' "
        "else '{\"model\":\" m1 \",\"n\":1e3,\"messages\":[{\"role\":\"user\",\"content\":' || $A || '},{\"role\":\"assistant\",\"content\":' || $T || '},"
        "{\"role\":\"user\",\"content\":[{\"type\":\"image\",\"text\":\"a@b.co\"},{\"type\":\"text\",\"text\":' || $B || '},{\"type\":\"text\",\"text\":' || $C || '}],\"k\":true}]}' end as body"
    )
    _COLS = (
        "request_id", "i", "text", "role", "i % 4 = 1 as opted_out",
        pick("i", ("/v1/messages", "/v1/chat/completions", "/v1/models", "/v1/messages", "/health")) + " as path",
    )

    @classmethod
    def body(cls, literal: str, a: str = "'first ' || text", b: str = "text", c: str = "'again ' || text") -> str:
        out = cls._BODY
        for name, value in (("$A", a), ("$B", b), ("$C", c), ("$T", "text")):
            out = out.replace(name, literal.format(value))
        return out

    def df(self, s, d):
        return parts(s, d).selectExpr("request_id * 100 + msg_idx as request_id", "request_id * 7 + msg_idx as i", "role", "text").selectExpr(
            *self._COLS, self.body("substring(to_json(named_struct('t', {0})), 6, length(to_json(named_struct('t', {0}))) - 6)"))

    @property
    def sql(self) -> str:
        source = f"(select request_id * 100 + msg_idx as request_id, request_id * 7 + msg_idx as i, role, text from {PARTS_SQL})"
        return f"(select {', '.join(self._COLS)}, {self.body('cast(to_json({0}) as varchar)')} from {source})"


INSPECT = _Inspect()


def policy_rows(s):
    prefs = s.createDataFrame([("phone", "warn"), ("url_path", "block")], "kind string, action string")
    rules = s.createDataFrame([("ip_address", "redact")], "kind string, action string")
    return prefs, rules


CHAT_SQL = f"(select * from {INSPECT.sql} where path in ('/v1/messages', '/v1/chat/completions'))"
INSPECT_TEXTS = (
    "(" + " union all ".join(
        f"select request_id, i % 17 = 5 as one_turn, opted_out, {m} as msg_idx, {b} as blk_idx, {t} as text from {CHAT_SQL} where {w}"
        for m, b, t, w in ((0, -1, "'first ' || text", "i % 17 <> 3"), (2, 1, "text", "i % 17 not in (3, 5)"), (2, 2, "'again ' || text", "i % 17 not in (3, 5)"))
    ) + ")"
)
INSPECT_FOUND = (
    f"(select *, case when opted_out and {TIER_SQL} = 'high' then 'skip' when kind = 'phone' then 'warn' when kind = 'url_path' then 'block' "
    f"when kind = 'ip_address' then 'redact' else {DEFAULT_SQL} end as action from "
    + findings_sql(INSPECT_TEXTS, "request_id, one_turn, opted_out, msg_idx, blk_idx") + ")"
)


def _inspect_audit_sql() -> str:
    o = "blk_idx * 1000000 + seq"
    stats = (
        "(select request_id, string_agg(distinct kind || '=' || kn, ',' order by kind || '=' || kn) as kinds, count(*) filter (where action = 'redact_one_way') as n_one_way, "
        "count(*) filter (where action in ('redact', 'warn')) as n_tokenized, count(*) filter (where action = 'allow') as n_allowed, count(*) filter (where action = 'skip') as n_skipped, "
        f"arg_min(kind, {o}) filter (where action = 'redact_one_way') as notify_kind, arg_min(kind, {o}) filter (where action = 'block') as block_kind from "
        f"(select *, count(*) over (partition by request_id, kind) as kn from {INSPECT_FOUND} where msg_idx = case when one_turn then 0 else 2 end) group by request_id)"
    )
    return (
        "select request_id, path as endpoint, case when i % 17 in (3, 5) then '' else 'm1' end as model, "
        "case when coalesce(block_kind, '') <> '' then block_kind else regexp_replace(coalesce(kinds, ''), '=[0-9]+', '', 'g') end as dlp_findings, coalesce(kinds, '') as kinds, "
        "coalesce(notify_kind, '') as notify_kind, coalesce(block_kind, '') as block_kind, coalesce(n_one_way, 0) as n_one_way, coalesce(n_tokenized, 0) as n_tokenized, "
        "coalesce(n_allowed, 0) as n_allowed, coalesce(n_skipped, 0) as n_skipped, case when coalesce(block_kind, '') <> '' then 'blocked_dlp' "
        f"when coalesce(n_one_way, 0) + coalesce(n_tokenized, 0) > 0 then 'redacted' else 'allowed' end as verdict from {CHAT_SQL} left join {stats} using (request_id)"
    )


# --- gateway
GATE = Derived(
    "request_id", "1704067200000000 + request_id * 600000000 as us",
    "case when request_id % 10 = 9 then 'bad' else 'sk-gw-' || cast(request_id % 40 as string) end as api_key",
    pick("request_id", ("/v1/chat/completions", "/v1/messages")) + " as endpoint",
    pick("request_id", ("unary", "streaming", "unary", "unary", "unary", "streaming", "batch")) + " as mode",
    pick("request_id", ("claude-x", "gpt", "gpt-4o-mini")) + " as model", "cast(19724 + request_id % 4 as bigint) as snapshot",
    pick("request_id", (None, "unavailable", None, None, "client_abort", None, None, None)) + " as send_error",
    "cast(request_id * 13 % 700 as bigint) as duration_ms",
    source=lambda s, d: read_table(s, d, "conversations").filter("turn = 0").selectExpr("conv_id as request_id"),
    source_sql="(select conv_id as request_id from conversations where turn = 0)",
)
GATE_PRINCIPALS = Derived(
    "case when c_custkey % 11 = 3 then 'sk-gw-old-' else 'sk-gw-' end || cast(c_custkey as string) as api_key", "c_mktsegment as tenant_id", "c_name as key_id",
    "'b' || cast(c_custkey % 10 as string) as budget_ref",
    "case when c_custkey % 13 = 5 then cast(1704067200000000 as bigint) end as expiry_us",
    source=lambda s, d: read_table(s, d, "customer"), source_sql="customer",
)
GATE_LIMITS = Derived(
    "'b' || cast(n_nationkey as string) as budget_ref", "cast(n_nationkey % 4 as int) as daily_requests",
    source=lambda s, d: read_table(s, d, "nation"), source_sql="nation",
)
GATE_POLICY = gateway.GatewayPolicy(actions={"email": "warn", "credit_card": "block"}, threshold=90, max_part_bytes=3000)


def gate_parts(s, d):
    return modal(s, d).withColumn("text", F.expr(f"text || {attack_sql('(request_id + 3 * msg_idx)')}"))


GATE_PARTS_SQL = f"(select * replace (text || {attack_sql('(request_id + 3 * msg_idx)')} as text) from {MODAL_SQL})"


def _gateway_sql() -> str:
    text_parts = f"(select * from {GATE_PARTS_SQL} where modality = 'text')"
    found = tier1_sql(text_parts)["found"]
    rules = matches_sql(f"(select * from {text_parts} where role in ('user', 'tool'))", "request_id, msg_idx")
    firsts = ", ".join(
        f"arg_min(id, pos) filter (where kind = '{k}' and health = 'healthy') as {n}" for k, n in (("anthropic", "anth"), ("openai", "oai"))
    )
    grid = "(select snapshot, p.* from (select distinct day as snapshot from " + SENDS.sql + ") cross join (values " + ", ".join(
        f"({p[0]}, '{p[1]}', '{p[2]}')" for p in R.PROVIDERS) + ") p(pos, id, kind))"
    snap = (
        f"(select snapshot, {firsts} from (select *, case when n < 10 then 'healthy' when e * 1.0 / n > 0.5 then 'unavailable' when e * 1.0 / n > 0.1 then 'degraded' else 'healthy' end as health from "
        f"(select g.snapshot, g.pos, g.id, g.kind, count(x.us) as n, count(x.us) filter (where {SQL_FAILED}) as e from {grid} g left join {SENDS.sql} x on x.upstream = g.id and x.day < g.snapshot group by all)) group by 1)"
    )
    return (
        f"with found as materialized (select * from {found}), hit as (select request_id, string_agg(distinct kind, ',' order by kind) filter (where kind <> 'email') as kinds, "
        "bool_or(kind = 'email') as warned, bool_or(kind = 'credit_card') as blocked from found group by 1), "
        f"rule as materialized (select * from {rules}), inj as (select request_id, sum(weight) as score, string_agg(rule_id, ',' order by m * 100 + rule_ord) filter (where m = msg_idx) as rules from "
        "(select *, min(msg_idx) over (partition by request_id, rule_id) as m from rule) group by 1), "
        f"per as (select request_id, count(*) as n_parts, count(*) filter (where modality <> 'text') as n_other, count(*) filter (where modality = 'text' and strlen(text) > 3000) as n_large from {GATE_PARTS_SQL} group by 1), "
        "base as (select g.*, p.tenant_id, p.key_id, p.budget_ref, n_other, n_large, coalesce(score, 0) as score, coalesce(rules, '') as rules, coalesce(kinds, '') as kinds, coalesce(warned, false) as warned, coalesce(blocked, false) as blocked, "
        "case when p.api_key is null or g.us > p.expiry_us then 'auth_failed' when g.mode = 'batch' or coalesce(n_parts, 0) = 0 then 'config_invalid' end as early "
        f"from {GATE.sql} g left join {GATE_PRINCIPALS.sql} p using (api_key) left join per using (request_id) left join hit using (request_id) left join inj using (request_id)), "
        "ranked as (select *, row_number() over (partition by budget_ref, us // 86400000000, early is null order by us, request_id) as rn from base), "
        f"spent as (select r.*, early is null and (coalesce(daily_requests, 0) <= 0 or rn <= daily_requests) as allowed from ranked r left join {GATE_LIMITS.sql} l using (budget_ref)), "
        f"routed as (select s.*, coalesce(case when starts_with(model, 'claude') then anth end, oai) as up from spent s left join {snap} using (snapshot)), "
        "done as (select *, case when early is not null then early when not allowed then 'budget_exceeded' when n_other > 0 then 'config_invalid' when blocked then 'dlp_blocked' when score >= 90 then 'policy_blocked' "
        "when n_large > 0 then 'config_invalid' when up is null then 'cap_mismatch' else send_error end as error, early is null and allowed and n_other = 0 as reached from routed) "
        "select us, request_id, tenant_id, key_id, endpoint, mode, case when reached and (error is null or error = send_error) then up end as upstream, "
        "case when reached and (error is null or error = send_error) then model end as model, case when error is null then case when kinds <> '' then 'redacted' when warned then 'warned' else 'allowed' end "
        "when error = 'dlp_blocked' then 'blocked_dlp' when error = 'policy_blocked' then 'blocked_policy' when error = 'auth_failed' then error when error = 'unavailable' then 'upstream_error' else 'error' end as verdict, "
        "case when reached and coalesce(error, '') <> 'dlp_blocked' then kinds else '' end as dlp_findings, cast(case when reached then score else 0 end as integer) as injection_score, "
        "case when reached then rules else '' end as injection_rules, duration_ms, error from done"
    )


def gateway_rows(s, d):
    snaps = R.snapshots(SENDS.df(s, d), "upstream", "status", "net_error", "day")
    principals = GATE_PRINCIPALS.df(s, d).withColumn("key_hash", F.sha2("api_key", 256)).drop("api_key")
    return gateway.gateway_audit(GATE.df(s, d), gate_parts(s, d), principals, GATE_LIMITS.df(s, d), snaps, GATE_POLICY)


def register(c: Catalog) -> None:
    for shape, read in (("openai", wire.read_openai_requests), ("anthropic", wire.read_anthropic_requests)):
        c.add(
            f"read_{shape}_requests",
            lambda s, d, read=read: read(BODIES.df(s, d), "body").select("request_id", "model", "mode", "error"),
            f"select request_id, case when error is null then 'm' || (i % 5) end as model, case when error is null then case when i % 13 = 4 then 'streaming' else 'unary' end end as mode, error from {expected(shape)}",
        )
        c.add(
            f"{shape}_messages",
            lambda s, d, read=read: wire.explode_messages(read(BODIES.df(s, d), "body"), ["request_id"]),
            f"select * from {expected_parts(shape)}",
        )
    done = "p = '[DONE]'"
    c.add(
        "read_openai_sse",
        lambda s, d: wire.read_openai_sse(lines(LINES, s, d), "stream", "line_no", "line"),
        "select stream, seq, case when e is null then coalesce(json_extract_string(p, '$.choices[0].delta.content'), '') end as delta, "
        "case when e is null then case json_extract_string(p, '$.choices[0].finish_reason') when 'stop' then 'stop' when 'length' then 'length' when 'odd' then 'unknown' end end as finish, "
        f"case when e = 'bad' then 'provider' end as err from {sse_sql(LINES, 'true', done)} where e = 'bad' or json_array_length(p, '$.choices') > 0",
    )
    ty = "json_extract_string(p, '$.type')"
    keep = f"(({ty} = 'content_block_delta' and json_extract_string(p, '$.delta.text') <> '') or {ty} = 'message_delta')"
    c.add(
        "read_anthropic_sse",
        lambda s, d: wire.read_anthropic_sse(lines(ANT_LINES, s, d), "stream", "line_no", "line"),
        f"select stream, seq, case when e is null then case when {ty} = 'content_block_delta' then json_extract_string(p, '$.delta.text') else '' end end as delta, "
        "case when e is null then case json_extract_string(p, '$.delta.stop_reason') when 'end_turn' then 'stop' when 'max_tokens' then 'length' when 'odd' then 'unknown' end end as finish, "
        f"case when e = 'bad' then 'provider' end as err from {sse_sql(ANT_LINES, keep, 'ok and ' + ty + chr(61) + chr(39) + 'message_stop' + chr(39))} where e = 'bad' or {keep}",
    )
    c.add(
        "read_openai_responses",
        lambda s, d: wire.read_responses(RESP.df(s, d).select("request_id", "body"), "body", "openai").drop("body"),
        "select request_id, case when i % 6 > 1 then 'assistant' end as role, case when i % 6 > 1 then text end as text, case when i % 6 > 1 then 'm' || (i % 3) end as model, "
        "case when i % 6 > 1 then i end as input_tokens, case when i % 6 > 1 then 7::bigint end as output_tokens, case when i % 6 > 1 then i + 7 end as total_tokens, "
        f"case i % 6 when 0 then 'empty choices' when 1 then 'decode' end as error from {RESP.sql}",
    )
    c.add(
        "read_anthropic_responses",
        lambda s, d: wire.read_responses(RESP.df(s, d).select("request_id", "abody"), "abody", "anthropic").drop("abody"),
        "select request_id, case when i % 6 <> 1 then 'assistant' end as role, case when i % 6 <> 1 then text || '!' end as text, case when i % 6 <> 1 then 'm' || (i % 3) end as model, "
        "case when i % 6 <> 1 then i end as input_tokens, case when i % 6 <> 1 then 3::bigint end as output_tokens, case when i % 6 <> 1 then i + 3 end as total_tokens, "
        f"case i % 6 when 1 then 'decode' end as error from {RESP.sql}",
    )
    tok = ("cast(request_id as bigint) as input_tokens", "cast(7 as bigint) as output_tokens", "cast(request_id + 7 as bigint) as total_tokens", "cast(1704067200 as bigint) as created")

    def answered(s, d):
        return parts(s, d).filter("role = 'assistant'").selectExpr("request_id * 100 + msg_idx as id", "text", "'m1' as model", *tok)

    answered_sql = f"(select request_id * 100 + msg_idx as id, text, 'm1' as model, {', '.join(tok)} from {PARTS_SQL} where role = 'assistant')"
    c.add(
        "render_openai", lambda s, d: wire.render_openai(answered(s, d), "id", "created").select("id", "body"),
        "select id, to_json({'id': 'resp-' || id, 'object': 'chat.completion', 'created': created, 'model': model, 'choices': [{'index': 0, 'message': {'role': 'assistant', 'content': text}, 'finish_reason': 'stop'}], "
        f"'usage': {{'prompt_tokens': input_tokens, 'completion_tokens': output_tokens, 'total_tokens': total_tokens}}}})::varchar as body from {answered_sql}",
    )
    c.add(
        "render_anthropic", lambda s, d: wire.render_anthropic(answered(s, d), "id").select("id", "body"),
        "select id, to_json({'id': 'resp-' || id, 'type': 'message', 'role': 'assistant', 'model': model, 'content': [{'type': 'text', 'text': text}], 'stop_reason': 'end_turn', "
        f"'usage': {{'input_tokens': input_tokens, 'output_tokens': output_tokens}}}})::varchar as body from {answered_sql}",
    )
    c.add(
        "body_probes",
        lambda s, d: BODIES.df(s, d).select("request_id", C.extract_model(F.col("body")).alias("model"), C.wants_stream(F.col("body")).alias("stream")),
        f"select request_id, case when i % 13 in (6, 7, 11) then '' else 'm' || (i % 5) end as model, i % 13 = 4 as stream from {CLEAN_PARTS.sql}",
    )
    c.add(
        "canonical_ids",
        lambda s, d: AUDIT.df(s, d).select(
            "request_id", C.fill_id(F.expr("case when request_id % 3 = 0 then cast(request_id as string) else '' end"), F.col("tenant_id"), F.col("request_id")).alias("id")),
        f"select request_id, case when request_id % 3 = 0 then cast(request_id as varchar) else left(sha256(tenant_id || '|' || request_id), 16) end as id from {AUDIT.sql}",
    )
    # --- corpus
    report_items = (
        "select doc_id, count(*) as total, string_agg('{\"kind\":\"' || kind || '\",\"line\":' || line || ',\"col\":' || col || ',\"start\":' || start || ',\"end\":' || \"end\" || ',\"text\":' || to_json(text)::varchar || '}', ',' order by seq) as items from "
        "(select f.*, len(string_split(prefix, chr(10))) as line, length(string_split(prefix, chr(10))[-1]) + 1 as col from (select f.*, decode(encode(t.text)[1:f.start]) as prefix "
        f"from {FINDINGS} f join {DOCUMENTS_SQL} t using (doc_id)) f) group by doc_id"
    )
    c.add(
        "findings_report", lambda s, d: corpus.findings_report(documents(s, d), "doc_id", "text"),
        "select doc_id, cast(coalesce(total, 0) as integer) as total, '{\"source\":\"' || doc_id || '\",\"total\":' || coalesce(total, 0) || ',\"findings\":[' || coalesce(items, '') || ']}' as report "
        f"from documents left join ({report_items}) using (doc_id)",
    )
    preview = (
        "case when strlen(text) <= 8 then repeat('*', strlen(text)) else decode(encode(text)[1:3]) || repeat('*', strlen(text) - 6) || decode(encode(text)[strlen(text) - 2:strlen(text)]) end"
    )
    c.add(
        "located_findings", lambda s, d: corpus.located_findings(documents(s, d), "doc_id", "text").drop("line", "col"),
        f"select doc_id, seq, kind, start, \"end\", {preview} as preview from {FINDINGS}",
    )
    bucket = "case when kind in ('api_key','aws_key','github_token','private_key','password') then 'secret' when kind in ('email','phone','ssn','credit_card') then 'pii' else 'other' end"
    c.add(
        "corpus_report", lambda s, d: corpus.corpus_report(documents(s, d), "doc_id", "text"),
        f"select kind, {TIER_SQL} as tier, {bucket} as bucket, count(*) as findings, count(distinct doc_id) as documents, min({preview}) as preview from {FINDINGS} group by 1, 2, 3",
    )
    c.add(
        "corpus_report_by_source", lambda s, d: corpus.corpus_report(documents(s, d), "doc_id", "text", ["source", "lang"]).drop("preview"),
        f"select source, lang, kind, {TIER_SQL} as tier, {bucket} as bucket, count(*) as findings, count(distinct doc_id) as documents from {FINDINGS} join {DOCUMENTS_SQL} d using (doc_id) group by 1, 2, 3, 4, 5".replace("join (select doc_id, text", "join (select doc_id, text as whole_text, text"),
    )
    # --- inspection and gateway
    c.add("inspect_audit", lambda s, d: inspection.inspect_audit(INSPECT.df(s, d), *policy_rows(s)), _inspect_audit_sql())
    c.add(
        "inspect_findings",
        lambda s, d: inspection.inspect_findings(INSPECT.df(s, d), *policy_rows(s))[1].select("request_id", "msg_idx", "blk_idx", "seq", "kind", "action"),
        f"select request_id, msg_idx, blk_idx, seq, kind, action from {INSPECT_FOUND}",
    )
    place = "request_id, msg_idx, blk_idx"
    named = f"(select *, row_number() over (partition by request_id order by msg_idx, blk_idx, seq) as n from {INSPECT_FOUND} where action in ('redact', 'warn'))"
    pairs = (
        f"(select {place}, seq, text as old, {pseudonym_sql('kind', 'n', 'request_id', 'text')} as new from {named} union all "
        f"select {place}, seq, text, {ONE_WAY_SQL} from {INSPECT_FOUND} where action = 'redact_one_way')"
    )
    quoted = "'(?:' || string_agg(regexp_replace(old, '([\\\\.\\[\\]{}()*+?^$|/-])', '\\\\\\1', 'g'), '|' order by seq) || ')'"
    grouped = f"(select {place}, list(old order by seq) as old, list(new order by seq) as new, {quoted} as pat from {pairs} group by {place})"
    swapped = (
        f"(select t.request_id, t.msg_idx, t.blk_idx, case when pat is null then text else array_to_string(list_transform(range(1, len(pc) + 1), lambda j: pc[j] || coalesce(new[list_position(old, m[j])], '')), '') end as new_text, pat is not null as hit from "
        f"(select t.*, g.old, g.new, g.pat, string_split_regex(t.text, g.pat) as pc, regexp_extract_all(t.text, g.pat, 0) as m from {INSPECT_TEXTS} t left join {grouped} g using (request_id, msg_idx, blk_idx)) t)"
    )
    wide = (
        f"(select request_id, bool_or(hit) as hit, max(new_text) filter (where msg_idx = 0) as a, max(new_text) filter (where blk_idx = 1) as b, max(new_text) filter (where blk_idx = 2) as c from {swapped} group by 1)"
    )
    c.add(
        "redact_json_bodies",
        lambda s, d: inspection.inspect_bodies(INSPECT.df(s, d), *policy_rows(s), SALT),
        f"select i.request_id, i % 17 <> 3 as parsed, {_Inspect.body('cast(to_json({0}) as varchar)', 'a', 'b', 'c')} from "
        f"(select i.request_id, i.i, i.text, coalesce(w.a, 'first ' || text) as a, coalesce(w.b, text) as b, coalesce(w.c, 'again ' || text) as c from {INSPECT.sql} i left join {wide} w using (request_id)) i",
    )
    flat = {"dlp_findings": F.array_join, "injection_rules": F.array_join}
    c.add(
        "gateway_audit",
        lambda s, d: gateway_rows(s, d).withColumns({k: f(k, ",") for k, f in flat.items()}),
        _gateway_sql(),
    )
    # --- extension points
    c.add(
        "scan_findings_sql", lambda s, d: X.scan_totals_by_kind(s, documents(s, d), "doc_id", "text", "findings_of_documents"),
        f"select kind, count(*) as n, count(distinct doc_id) as docs from {FINDINGS} group by kind",
    )
    def scan_function(s, d):
        X.register_scan_function(prepare(s))
        documents(s, d).createOrReplaceTempView("scanned_documents")
        return s.sql("SELECT d.doc_id, f.* FROM scanned_documents d, LATERAL scan_findings(d.text) f")

    c.add("scan_function", scan_function, f"select * from {FINDINGS}")
    c.add(
        "custom_stages",
        lambda s, d: X.run_stages(
            turns(s, d),
            [X.Stage("length", lambda df: df.withColumn("n", F.octet_length("text")), ("text",), ("n",)),
             X.Stage("long", lambda df: df.withColumn("is_long", F.col("n") > 1000), ("n",), ("is_long",))],
        ).groupBy("is_long").agg(F.count("*").alias("parts")),
        f"select strlen(text) > 1000 as is_long, count(*) as parts from {TURNS_SQL} group by 1",
    )
