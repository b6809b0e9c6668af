"""Queries on detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwork.catalog.base import DOCUMENTS_SQL, Catalog, documents
from maskwork.functions import patterns as P
from maskwork.functions.kinds import LABELS, label
from maskwork.functions.masking import mask_preview
from maskwork.functions.patterns import luhn_valid, register_pattern
from maskwork.functions.text import line_and_column
from maskwork.operators import detect as D
from maskwork.operators.metrics import findings_by_kind, findings_rollup
from maskwork.sources.corpus import read_table, scan_corpus

RAW = {
    "api_key": P.API_KEY, "aws_key": P.AWS_KEY, "github_token": P.GITHUB_TOKEN, "private_key": P.PRIVATE_KEY,
    "credit_card": P.CREDIT_CARD, "ssn": P.SSN, "email": P.EMAIL, "phone": P.PHONE,
    "ip_address": P.IP_ADDRESS, "url_path": P.URL_PATH,
}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn_sql(raw: str) -> str:
    d = f"regexp_replace({raw}, '[^0-9]', '', 'g')"
    digit = f"cast(substr(reverse({d}), j, 1) as integer)"
    total = (
        f"list_sum(list_transform(range(1, length({d}) + 1), lambda j: case when j % 2 = 1 then {digit} "
        f"when {digit} > 4 then {digit} * 2 - 9 else {digit} * 2 end))"
    )
    return f"coalesce(length({d}) between 13 and 19 and {total} % 10 = 0, false)"


def located_sql(pattern: str, source: str, key: str, text: str = "text", group: int = 0) -> str:
    """key, n, start, end, value of every match, with byte offsets, in SQL."""
    q = quote(pattern)
    # string_split_regex gives the pieces between matches, regexp_extract_all the matches.
    return (
        f"(select {key}, i - 1 as n, val as value, e as \"end\", e - strlen(val) as start from (select {key}, i, v[i] as val, "
        "cast(list_sum(list_transform(pc[1:i], lambda x: strlen(x))) + list_sum(list_transform(m[1:i], lambda x: strlen(x))) as integer) as e "
        f"from (select {key}, m, v, pc, unnest(range(1, len(m) + 1)) as i from (select {key}, regexp_extract_all({text}, {q}, 0) as m, "
        f"regexp_extract_all({text}, {q}, {group}) as v, string_split_regex({text}, {q}) as pc from {source} src))))"
    )


def kind_sql(kind: str, source: str, key: str, text: str = "text", pattern: str | None = None) -> str:
    """Findings of one kind: key, kind, ord, start, end, text."""
    if kind == "password":
        both = (
            f"select {key}, 0 as f, n, start, \"end\", value from {located_sql(P.PASSWORD_LABEL, source, key, text, 1)} union all "
            f"select {key}, 1 as f, n, start, \"end\", value from {located_sql(P.PASSWORD_VERB, source, key, text, 1)}"
        )
        keep = (
            "where not (lower(value) in ('xxx', '***', '<redacted>') or starts_with(value, '[') or starts_with(value, '<'))"
        )
        rows = (
            f"select {key}, start, \"end\", value, min(f * 1000000 + n) as o from ({both}) {keep} group by all"
        )
    else:
        where = f"where {luhn_sql('value')}" if kind == "credit_card" else ""
        rows = (
            f"select {key}, start, \"end\", value, n as o from {located_sql(pattern or RAW[kind], source, key, text)} {where}"
        )
    return (
        f"(select {key}, '{kind}' as kind, cast(row_number() over (partition by {key} order by o) - 1 as integer) as ord, "
        f"cast(start as integer) as start, \"end\", value as text from ({rows}))"
    )


def findings_sql(source: str, key: str, text: str = "text", kinds=None) -> str:
    """All findings: key, kind, ord, start, end, text, seq."""
    arms = []
    for i, kind in enumerate(P.KIND_ORDER):
        if kinds is None or kind in kinds:
            arms.append(f"select *, {i} as k from {kind_sql(kind, source, key, text)}")
    union = " union all ".join(arms)
    return (
        f"(select {key}, kind, ord, start, \"end\", text, "
        f"cast(row_number() over (partition by {key} order by k, ord) - 1 as integer) as seq from ({union}))"
    )


def _with_text(scanned):
    """One row per finding beside the text it was found in."""
    whole = scanned.withColumnRenamed("text", "whole")
    return D.explode_findings(whole, ["doc_id", "whole"]).withColumnRenamed("text", "value").withColumnRenamed("whole", "text")


FINDINGS = findings_sql(DOCUMENTS_SQL, "doc_id")


def register(c: Catalog) -> None:
    for kind in P.KIND_ORDER:
        c.add(
            f"detect_{kind}",
            lambda s, d, kind=kind: D.detect(documents(s, d), ["doc_id"], "text", kind),
            f"select * from {kind_sql(kind, DOCUMENTS_SQL, 'doc_id')}",
        )
    c.add(
        "luhn_valid",
        lambda s, d: read_table(s, d, "orders").select(
            "o_orderkey",
            luhn_valid(F.expr("lpad(cast(o_orderkey * 7919 as string), 4 + cast(o_custkey % 18 as int), '4')")).alias("ok"),
        ),
        "select o_orderkey, "
        + luhn_sql("lpad(cast(o_orderkey * 7919 as varchar), cast(4 + o_custkey % 18 as integer), '4')")
        + " as ok from orders",
    )
    c.add(
        "drop_placeholders",
        lambda s, d: documents(s, d).select(
            "doc_id", F.posexplode(F.split("text", "[\\t\\n\\f\\r ]+")).alias("i", "word")
        ).filter(D.is_placeholder(F.col("word"))).groupBy("word").agg(F.count("*").alias("n")),
        "select word, count(*) as n from (select unnest(string_split_regex(text, '[\\t\\n\\f\\r ]+')) as word from "
        f"{DOCUMENTS_SQL}) where lower(word) in ('xxx', '***', '<redacted>') or starts_with(word, '[') or starts_with(word, '<') group by word",
    )
    intent = " or ".join(f"regexp_matches(ctx, {quote(p)})" for p in P.INTENT_PHRASES)
    c.add(
        "looks_intentional",
        lambda s, d: D.with_findings(documents(s, d), "text").transform(_with_text).select("doc_id", "kind", "ord", D.looks_intentional(F.col("text"), F.col("start"), F.col("end")).alias("intentional")),
        f"select doc_id, kind, ord, ({intent}) as intentional from (select doc_id, kind, ord, "
        "lower(list_aggregate(list_transform(range(greatest(start - 80, 0), least(\"end\" + 80, octet_length(b))), "
        "lambda i: case when ascii_code[i + 1] between 1 and 127 then chr(cast(ascii_code[i + 1] as integer)) else 'é' end), 'string_agg', '')) as ctx from "
        "(select f.doc_id, f.kind, f.ord, f.start, f.\"end\", b, ascii_code from "
        f"{FINDINGS} f join (select doc_id, b, list_transform(range(1, octet_length(b) + 1), lambda i: cast('0x' || substr(hex(b), 2 * i - 1, 2) as integer)) as ascii_code "
        f"from (select doc_id, encode(text) as b from {DOCUMENTS_SQL})) t using (doc_id)))",
    )
    c.add("scan_all", lambda s, d: D.scan_all(documents(s, d), ["doc_id"], "text"), f"select * from {FINDINGS}")
    c.add(
        "line_col",
        lambda s, d: D.with_findings(documents(s, d), "text").transform(_with_text).select("doc_id", "kind", "ord", line_and_column(F.col("text"), F.col("start")).alias("p"))
        .select("doc_id", "kind", "ord", "p.line", "p.col"),
        "select doc_id, kind, ord, cast(len(string_split(prefix, chr(10))) as integer) as line, "
        "cast(length(string_split(prefix, chr(10))[-1]) + 1 as integer) as col from "
        f"(select f.doc_id, f.kind, f.ord, decode(encode(t.text)[1:f.start]) as prefix from {FINDINGS} f join {DOCUMENTS_SQL} t using (doc_id))",
    )
    c.add(
        "count_by_kind",
        lambda s, d: D.count_by_kind(D.scan_all(documents(s, d), ["doc_id"], "text"), ["doc_id"]),
        f"select doc_id, kind, count(*) as n from {FINDINGS} group by doc_id, kind",
    )
    c.add(
        "scan_status",
        lambda s, d: D.scan_status(D.with_findings(documents(s, d), "text"), ["doc_id"]),
        "select doc_id, cast(coalesce(n, 0) as integer) as n_findings, coalesce(n, 0) > 0 as failed from documents left join "
        f"(select doc_id, count(*) as n from {FINDINGS} group by doc_id) using (doc_id)",
    )
    c.add(
        "summarize_kinds",
        lambda s, d: D.summarize_kinds(D.scan_all(documents(s, d), ["doc_id"], "text"), ["doc_id"]),
        "select doc_id, string_agg(kind || '=' || n, ',' order by kind || '=' || n) as kinds from "
        f"(select doc_id, kind, count(*) as n from {FINDINGS} group by doc_id, kind) group by doc_id",
    )
    c.add(
        "scan_totals",
        lambda s, d: D.scan_totals(D.with_findings(documents(s, d), "text")),
        f"select (select count(*) from documents) as scanned, (select count(*) from {FINDINGS}) as findings",
    )
    labels = " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items())
    c.add(
        "kind_label",
        lambda s, d: D.scan_all(documents(s, d), ["doc_id"], "text").groupBy(label(F.col("kind")).alias("label")).agg(F.count("*").alias("n")),
        f"select case kind {labels} else kind end as label, count(*) as n from {FINDINGS} group by 1",
    )
    c.add(
        "scan_corpus",
        lambda s, d: scan_corpus(documents(s, d), "text", 16384).select("doc_id", F.octet_length("text").alias("bytes"), "oversized"),
        f"select doc_id, cast(strlen(text) as integer) as bytes, strlen(text) > 16384 as oversized from {DOCUMENTS_SQL}",
    )
    c.add(
        "union_findings",
        lambda s, d: D.union_findings(
            D.findings(documents(s, d), ["doc_id"], "text", kinds=["email", "ssn"]).drop("seq"),
            D.detect(documents(s, d), ["doc_id"], "text", "password"),
        ).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("bigint")).alias("sum_start")),
        f"select kind, count(*) as n, cast(sum(start) as bigint) as sum_start from {FINDINGS} where kind in ('email', 'ssn', 'password') group by kind",
    )
    c.add(
        "distinct_ranges",
        lambda s, d: D.scan_all(documents(s, d), ["doc_id"], "text").select("doc_id", "start", "end").dropDuplicates(),
        f"select distinct doc_id, start, \"end\" from {FINDINGS}",
    )
    ticket = r"\bTCK-\d{4,8}\b"
    c.add(
        "custom_pattern",
        lambda s, d: D.findings(
            documents(s, d).withColumn("text", F.expr("text || ' TCK-' || lpad(cast(doc_id as string), 6, '0')")),
            ["doc_id"], "text", kinds=["ticket"],
            patterns=register_pattern(P.BUILTIN, "ticket", ticket, lambda v: F.right(v, F.lit(1)) != "7"),
        ).drop("seq"),
        "select doc_id, kind, ord, start, \"end\", text from "
        + kind_sql("ticket", f"(select doc_id, text || ' TCK-' || lpad(cast(doc_id as varchar), 6, '0') as text from {DOCUMENTS_SQL})",
                   "doc_id", pattern=ticket)
        + " where text[-1] <> '7'",
    )
    c.add(
        "preview",
        lambda s, d: D.scan_all(documents(s, d), ["doc_id"], "text").select(
            "doc_id", "kind", "start", "end", mask_preview(F.col("text")).alias("text")
        ),
        "select doc_id, kind, start, \"end\", case when strlen(text) <= 8 then repeat('*', strlen(text)) else "
        "decode(encode(text)[1:3]) || repeat('*', strlen(text) - 6) || decode(encode(text)[strlen(text) - 2:strlen(text)]) end as text "
        f"from {FINDINGS}",
    )
    bucket = (
        "case when kind in ('api_key','aws_key','github_token','private_key','password') then 'secret' "
        "when kind in ('email','phone','ssn','credit_card') then 'pii' else 'other' end"
    )
    tier = (
        "case when kind in ('api_key','aws_key','github_token','private_key','credit_card','password') then 'high' "
        "when kind = 'ssn' then 'medium' else 'low' end"
    )

    def by_source(s, d):
        return D.findings(documents(s, d), ["doc_id", "source"], "text")

    sourced = f"(select f.kind, d.source from {FINDINGS} f join documents d using (doc_id))"
    c.add("findings_by_kind", lambda s, d: findings_by_kind(by_source(s, d), ["source"]),
          f"select source, kind, {tier} as tier, {bucket} as bucket, count(*) as n from {sourced} group by all")
    c.add("findings_rollup", lambda s, d: findings_rollup(by_source(s, d), "source"),
          f"select source, kind, count(*) as n from {sourced} group by rollup (source, kind)")
    c.add(
        "detect_api_key_any_case",
        lambda s, d: D.findings(
            documents(s, d).withColumn("text", F.expr("text || ' Token-' || repeat('Z', cast(16 + doc_id % 60 as int)) || ' SK_abcdefghijklmnop'")),
            ["doc_id"], "text", kinds=["api_key"], patterns=register_pattern(P.BUILTIN, "api_key", P.API_KEY_ANY_CASE),
        ).drop("seq"),
        "select * from " + kind_sql(
            "api_key", f"(select doc_id, text || ' Token-' || repeat('Z', cast(16 + doc_id % 60 as integer)) || ' SK_abcdefghijklmnop' as text from {DOCUMENTS_SQL})",
            "doc_id", pattern=P.API_KEY_ANY_CASE),
    )
