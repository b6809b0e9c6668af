"""Queries on actions, redaction, pseudonyms and restoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwork.catalog.base import DOCUMENTS_SQL, PARTS_SQL, Catalog, documents, parts
from maskwork.catalog.detect import FINDINGS, findings_sql, luhn_sql, quote
from maskwork.functions import kinds as K
from maskwork.functions import masking as M
from maskwork.functions import patterns as P
from maskwork.operators import detect as D
from maskwork.operators import redact as R
from maskwork.operators import vault as V
from maskwork.operators.ordering import last_user_turn
from maskwork.sources.corpus import read_table

SALT = "demo-salt"
KEY = ["request_id", "session_id", "msg_idx", "role"]
KEY_SQL = ", ".join(KEY)
PART_FINDINGS = findings_sql(PARTS_SQL, KEY_SQL)
POLICY = {"credit_card": "warn"}

TIER_SQL = (
    "case when kind in ('api_key','aws_key','github_token','private_key','credit_card','password') then 'high' "
    "when kind = 'ssn' then 'medium' else 'low' end"
)
DEFAULT_SQL = (
    "case when kind in ('api_key','aws_key','github_token','private_key','credit_card','password') then 'redact_one_way' "
    "when kind in ('ssn','email','phone') then 'redact' else 'allow' end"
)
MARKER_SQL = (
    "case when kind in ('api_key','aws_key','github_token','private_key','password','credit_card') "
    "then '[REDACTED_' || upper(kind) || ']' else '[REDACTED]' end"
)


def mask_sql(raw: str, n: int = 6) -> str:
    """Star the last n digits: walk the reversed characters and count the digits seen."""
    r = f"string_split(reverse({raw}), '')"
    digits = f"len(list_filter({r}[1:i], lambda c: regexp_matches(c, '^[0-9]$')))"
    return (
        f"reverse(array_to_string(list_transform(range(1, length({raw}) + 1), lambda i: "
        f"case when regexp_matches({r}[i], '^[0-9]$') and {digits} <= {n} then '*' else {r}[i] end), ''))"
    )


ONE_WAY_SQL = f"case when kind in ('credit_card','ssn') then {mask_sql('text')} else {MARKER_SQL} end"


def pseudonym_sql(kind: str, n: str, owner: str, plaintext: str) -> str:
    return (
        f"'[' || upper({kind}) || '_' || {n} || '_' || "
        f"left(sha256('{SALT}|' || {owner} || '|' || {n} || '|' || {plaintext}), 12) || ']'"
    )


def rebuilt_sql(source: str, text: str, pattern: str, lookup: str, out: str) -> str:
    """``source`` with a column ``out``: the text with every match m put through ``lookup``."""
    q = quote(pattern)
    return (
        f"(select * exclude (pc, m), array_to_string(list_transform(range(1, len(pc) + 1), lambda i: pc[i] || "
        f"coalesce({lookup.replace('$M', 'm[i]')}, m[i], '')), '') as {out} from (select *, string_split_regex({text}, {q}) as pc, "
        f"regexp_extract_all({text}, {q}, 0) as m from {source}))"
    )


def tier1_sql(source: str = PARTS_SQL) -> dict[str, str]:
    """Findings, vault and redacted texts of the first-tier passes over the chat parts."""
    keys = f"{KEY_SQL}"
    t1 = f"(select *, regexp_replace(text, {quote(P.SSN)}, '[]', 'g') as t1 from {source})"
    valid = luhn_sql("$M")
    t2 = rebuilt_sql(t1, "t1", P.CREDIT_CARD, f"case when {valid} then '[]' end", "t2")

    def hits(rows: str, text: str, pattern: str, kind: str, no: int, where: str = "") -> str:
        return (
            f"select {keys}, {no} as pass_no, i as pos, '{kind}' as kind, m[i] as value from (select *, unnest(range(1, len(m) + 1)) as i from "
            f"(select {keys}, regexp_extract_all({text}, {quote(pattern)}, 0) as m from {rows})) {where}"
        )

    found = (
        "(" + hits(source, "text", P.SSN, "ssn", 0) + " union all "
        + hits(t1, "t1", P.CREDIT_CARD, "credit_card", 1, f"where {luhn_sql('m[i]')}") + " union all "
        + hits(t2, "t2", P.EMAIL, "email", 2) + ")"
    )
    first = (
        f"(select session_id, value, arg_min(kind, o) as kind, min(o) as o from (select *, "
        f"msg_idx::bigint * 1000000000 + pass_no * 1000000 + pos as o from {found}) group by session_id, value)"
    )
    numbered = f"(select *, row_number() over (partition by session_id order by o) as n from {first})"
    vault = (
        f"(select session_id, value as plaintext, kind, n, {pseudonym_sql('kind', 'n', 'session_id', 'value')} as pseudonym from {numbered})"
    )
    maps = f"(select session_id as sid, map_from_entries(list((plaintext, pseudonym))) as mp from {vault} group by session_id)"
    look = "map_extract(mp, $M)[1]"
    r1 = rebuilt_sql(f"(select * from {source} p left join {maps} v on p.session_id = v.sid)", "text", P.SSN, look, "r1")
    r2 = rebuilt_sql(r1, "r1", P.CREDIT_CARD, look, "r2")
    r3 = f"(select {keys}, r3 as text from {rebuilt_sql(r2, 'r2', P.EMAIL, look, 'r3')})"
    return {"found": found, "vault": vault, "redacted": r3}


TIER1 = tier1_sql()


def tier1(s, d):
    return R.redact_tier1(
        parts(s, d), ["request_id", "msg_idx"], "session_id", "text", ["msg_idx"], POLICY, "redact", SALT
    )


def restored(s, d):
    """Redacted parts with unknown tokens behind them, restored by the vault of the same run."""
    redacted, _, vault = tier1(s, d)
    marked = redacted.withColumn("text", F.concat("text", F.lit(" [NOPE_1_abc] [x]")))
    return V.restore(marked, ["request_id", "msg_idx"], "session_id", "text", vault).select("request_id", "msg_idx", "text")


def acted(s, d):
    """Findings of the user messages with their layered action."""
    users = parts(s, d).filter(F.col("role") == "user")
    found = D.findings(users, KEY, "text")
    prefs = s.createDataFrame([("phone", "warn"), ("url_path", "block"), ("ssn", "")], "kind string, action string")
    rules = s.createDataFrame([("ip_address", "redact"), ("email", "unknown")], "kind string, action string")
    return R.resolve_action_layered(found, prefs, rules)


USER_FINDINGS = f"(select * from {PART_FINDINGS} where role = 'user')"
ACTED = (
    "(select *, case kind when 'phone' then 'warn' when 'url_path' then 'block' when 'ip_address' then 'redact' "
    f"else {DEFAULT_SQL} end as action from {USER_FINDINGS})"
)
SKIPPED = f"(select * replace (case when session_id % 3 = 0 and {TIER_SQL} = 'high' then 'skip' else action end as action) from {ACTED})"


def optedout(s, d):
    return R.apply_optout(acted(s, d).withColumn("opted_out", F.col("session_id") % 3 == 0))


def register(c: Catalog) -> None:
    base = lambda s, d: D.scan_all(documents(s, d), ["doc_id"], "text")
    def k():
        return F.col("kind")

    c.add("kind_tier", lambda s, d: base(s, d).groupBy("kind", K.tier(k()).alias("tier")).agg(F.count("*").alias("n")),
          f"select kind, {TIER_SQL} as tier, count(*) as n from {FINDINGS} group by 1, 2")
    c.add("kind_default_action",
          lambda s, d: base(s, d).groupBy("kind", K.default_action(k()).alias("action")).agg(F.count("*").alias("n")),
          f"select kind, {DEFAULT_SQL} as action, count(*) as n from {FINDINGS} group by 1, 2")
    c.add("kind_marker",
          lambda s, d: base(s, d).groupBy("kind", K.static_marker(k()).alias("marker")).agg(F.count("*").alias("n")),
          f"select kind, {MARKER_SQL} as marker, count(*) as n from {FINDINGS} group by 1, 2")
    names = "array('allow','warn','redact','block','redact_one_way','mask','one_way','Mask','')"
    c.add(
        "parse_action",
        lambda s, d: read_table(s, d, "events").select(
            "event_id", K.parse_action(F.expr(f"element_at({names}, cast(event_id % 9 + 1 as int))")).alias("action")
        ),
        "select event_id, case when a in ('allow','warn','redact','block','redact_one_way') then a "
        "when a in ('mask','one_way') then 'redact_one_way' else 'unknown' end as action from (select event_id, "
        "['allow','warn','redact','block','redact_one_way','mask','one_way','Mask',''][event_id % 9 + 1] as a from events)",
    )
    c.add(
        "mask_last_digits",
        lambda s, d: base(s, d).select("doc_id", "kind", "start", "end", M.mask_last_digits(F.col("text")).alias("masked")),
        f"select doc_id, kind, start, \"end\", {mask_sql('text')} as masked from {FINDINGS}",
    )
    c.add(
        "one_way_replacement",
        lambda s, d: base(s, d).select("doc_id", "kind", "start", "end", M.one_way_replacement(k(), F.col("text")).alias("marker")),
        f"select doc_id, kind, start, \"end\", {ONE_WAY_SQL} as marker from {FINDINGS}",
    )
    key = "'sk-gw-' || repeat('k', cast(c_custkey % 9 as int)) || lpad(cast(c_custkey as string), 4, '0')"
    key_sql = "'sk-gw-' || repeat('k', cast(c_custkey % 9 as integer)) || lpad(cast(c_custkey as varchar), 4, '0')"
    c.add(
        "mask_key",
        lambda s, d: read_table(s, d, "customer").select("c_custkey", F.expr(key).alias("key")).select(
            "c_custkey", M.mask_key_cli(F.col("key")).alias("cli"), M.mask_key_desktop(F.col("key")).alias("desktop"),
            M.mask_key_dashboard(F.substring("key", 7, 20)).alias("dashboard"),
        ),
        "select c_custkey, case when length(key) <= 10 then 'sk-gw-***' else left(key, 8) || repeat('*', length(key) - 12) || right(key, 4) end as cli, "
        "case when length(key) <= 10 then '' else left(key, 8) || '********' || right(key, 4) end as desktop, "
        "case when length(key) - 6 <= 4 then repeat('•', length(key) - 6) else '••••••••' || right(key, 4) end as dashboard "
        f"from (select c_custkey, {key_sql} as key from customer)",
    )
    c.add(
        "classify_kinds",
        lambda s, d: D.with_findings(documents(s, d), "text").select(
            "doc_id", K.classify_kinds(F.transform("findings", lambda f: f["kind"])).alias("c")
        ).select("doc_id", "c.had_secret", "c.had_pii"),
        "select doc_id, coalesce(s, false) as had_secret, coalesce(p, false) as had_pii from documents left join (select doc_id, "
        "bool_or(kind in ('api_key','aws_key','github_token','private_key','password')) as s, "
        f"bool_or(kind in ('email','phone','ssn','credit_card','person_name')) as p from {FINDINGS} group by doc_id) using (doc_id)",
    )
    c.add(
        "resolve_action",
        lambda s, d: base(s, d).select(
            "doc_id", "kind", "ord", R.resolve_action(k(), {"ssn": "block", "email": "unknown", "phone": "warn"}, "allow").alias("action")
        ),
        f"select doc_id, kind, ord, case kind when 'ssn' then 'block' when 'phone' then 'warn' else 'allow' end as action from {FINDINGS}",
    )
    c.add("resolve_action_layered", lambda s, d: acted(s, d).select("request_id", "msg_idx", "seq", "kind", "action"),
          f"select request_id, msg_idx, seq, kind, action from {ACTED}")
    c.add("apply_optout", lambda s, d: optedout(s, d).groupBy("action", "kind").agg(F.count("*").alias("n")),
          f"select action, kind, count(*) as n from {SKIPPED} group by 1, 2")
    c.add("block_requests", lambda s, d: R.block_requests(acted(s, d), "request_id", ["msg_idx", "seq"]),
          "select request_id, arg_min(kind, msg_idx * 100000 + seq) as block_kind "
          f"from {ACTED} where action = 'block' group by request_id")
    c.add(
        "split_findings",
        lambda s, d: R.split_findings(acted(s, d), "request_id"),
        "select request_id, coalesce(string_agg(kind || '=' || n, ',' order by kind || '=' || n) filter (where action in ('redact', 'block')), '') as findings, "
        "coalesce(string_agg(kind || '=' || n, ',' order by kind || '=' || n) filter (where action = 'warn'), '') as warnings, "
        "cast(coalesce(sum(n) filter (where action in ('redact', 'block')), 0) as bigint) as n_findings, "
        "cast(coalesce(sum(n) filter (where action = 'warn'), 0) as bigint) as n_warnings from "
        f"(select request_id, kind, action, count(*) as n from {ACTED} group by all) group by request_id",
    )
    c.add("redact_tier1", lambda s, d: tier1(s, d)[0].select("request_id", "msg_idx", "role", "text"),
          f"select request_id, msg_idx, role, text from {TIER1['redacted']}")
    c.add("tier1_findings",
          lambda s, d: tier1(s, d)[1].groupBy("request_id", "msg_idx", "kind", "action").agg(F.count("*").alias("n")),
          "select request_id, msg_idx, kind, case kind when 'credit_card' then 'warn' else 'redact' end as action, count(*) as n "
          f"from {TIER1['found']} group by all")
    c.add("tier1_vault", lambda s, d: tier1(s, d)[2], f"select session_id, plaintext, kind, n, pseudonym from {TIER1['vault']}")

    vault_first = (
        f"(select session_id, text, arg_min(kind, msg_idx * 1000000 + seq) as kind, min(msg_idx * 1000000 + seq) as o from {PART_FINDINGS} group by session_id, text)"
    )
    c.add(
        "build_vault",
        lambda s, d: V.build_vault(D.findings(parts(s, d), KEY, "text"), "session_id", ["msg_idx", "seq"], SALT, slice_size=2),
        f"select session_id, text as plaintext, kind, n, {pseudonym_sql('kind', 'n', 'session_id', 'text')} as pseudonym from "
        f"(select *, row_number() over (partition by session_id order by o) as n from {vault_first})",
    )
    local = (
        f"(select *, row_number() over (partition by request_id order by msg_idx, seq) as n from {USER_FINDINGS})"
    )
    c.add(
        "build_local_vault",
        lambda s, d: V.build_local_vault(
            D.findings(parts(s, d).filter(F.col("role") == "user"), KEY, "text"), "request_id", ["msg_idx", "seq"], SALT
        ).select("request_id", "msg_idx", "seq", "n", "pseudonym", "effective"),
        f"select request_id, msg_idx, seq, n, {pseudonym_sql('kind', 'n', 'request_id', 'text')} as pseudonym, "
        f"n = min(n) over (partition by request_id, msg_idx, text) as effective from {local}",
    )
    old, new = "array('123-45', 'the', 'th', '.', '[hid')", "array('<A>', '<B>', '<C>', '!', '(')"
    c.add(
        "replace_pairs",
        lambda s, d: documents(s, d).select("doc_id", R.replace_pairs(F.col("text"), F.expr(old), F.expr(new)).alias("text")),
        "select doc_id, out as text from " + rebuilt_sql(DOCUMENTS_SQL, "text", r"(?:123\-45|the|th|\.|\[hid)",
                                        "case $M when '123-45' then '<A>' when 'the' then '<B>' when 'th' then '<C>' when '.' then '!' when '[hid' then '(' end", "out"),
    )
    # Values of one way findings by list order, replaced in one pass over the text.
    c.add(
        "redact_one_way",
        lambda s, d: R.redact_one_way(D.with_findings(documents(s, d), "text"), "text").select("doc_id", "text"),
        _one_way_sql(),
    )
    c.add(
        "restore",
        restored,
        f"select request_id, msg_idx, text || ' [NOPE_1_abc] [x]' as text from {PARTS_SQL}",
    )
    c.add(
        "redaction_stats",
        lambda s, d: R.redaction_stats(
            optedout(s, d), last_user_turn(parts(s, d), "request_id", "msg_idx", "role", "text"), "request_id", "msg_idx"
        ),
        "select l.request_id, coalesce(kinds, '') as kinds, coalesce(n_one_way, 0) as n_one_way, coalesce(n_tokenized, 0) as n_tokenized, "
        "coalesce(n_allowed, 0) as n_allowed, coalesce(n_skipped, 0) as n_skipped, coalesce(notify_kind, '') as notify_kind, coalesce(block_kind, '') as block_kind from "
        f"(select request_id, max(msg_idx) as msg_idx from {PARTS_SQL} where role = 'user' group by 1) l left join "
        "(select request_id, string_agg(distinct kind || '=' || kn, ',' order by kind || '=' || kn) as kinds, count(*) filter (where action = 'redact_one_way') as n_one_way, "
        "count(*) filter (where action in ('redact', 'warn')) as n_tokenized, count(*) filter (where action = 'allow') as n_allowed, "
        "count(*) filter (where action = 'skip') as n_skipped, arg_min(kind, seq) filter (where action = 'redact_one_way') as notify_kind, "
        "arg_min(kind, seq) filter (where action = 'block') as block_kind from (select f.*, count(*) over (partition by f.request_id, kind) as kn "
        f"from {SKIPPED} f join (select request_id, max(msg_idx) as msg_idx from {PARTS_SQL} where role = 'user' group by 1) using (request_id, msg_idx)) group by request_id) st using (request_id)",
    )
    c.add("size_guard",
          lambda s, d: documents(s, d).groupBy(R.size_guard(F.col("text"), 4096).alias("too_large")).agg(F.count("*").alias("n")),
          f"select strlen(text) > 4096 as too_large, count(*) as n from {DOCUMENTS_SQL} group by 1")
    c.add(
        "leak_check",
        lambda s, d: R.find_leaks(
            parts(s, d), tier1(s, d)[0], ["request_id", "msg_idx"], "text", list(R.TIER1_KINDS)
        ).agg(F.count("*").alias("leaks")),
        "select 0::bigint as leaks",
    )


def _one_way_sql() -> str:
    """At each step the earliest match position wins, then the earliest listed value."""
    pairs = (
        f"(select doc_id, list(text order by seq) as old, list({ONE_WAY_SQL} order by seq) as new "
        f"from {FINDINGS} where {DEFAULT_SQL} = 'redact_one_way' group by doc_id)"
    )
    src = f"(select d.doc_id, d.text, p.old, p.new from {DOCUMENTS_SQL} d left join {pairs} p using (doc_id))"
    # Alternation of quoted values built per row, as a regular expression.
    pat = (
        "'(?:' || array_to_string(list_transform(old, lambda o: regexp_replace(o, '([\\\\.\\[\\]{}()*+?^$|/-])', '\\\\\\1', 'g')), '|') || ')'"
    )
    m = "m"
    return (
        "select doc_id, case when old is null then text else array_to_string(list_transform(range(1, len(pc) + 1), "
        f"lambda i: pc[i] || coalesce(new[list_position(old, {m}[i])], '')), '') end as text from "
        f"(select *, string_split_regex(text, pat) as pc, regexp_extract_all(text, pat, 0) as m from (select *, {pat} as pat from {src}))"
    )
