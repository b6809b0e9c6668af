"""Detection: one pass over a text column gives every finding of every kind.

All of it is native expressions evaluated in the row that holds the text, so a scan
needs no shuffle whatever the size of the corpus.  Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.patterns import BUILTIN, INTENT_PHRASES, PASSWORDS, Pattern, luhn_sql, luhn_valid, to_java
from maskwork.functions.text import byte_slice, located_sql, raw_literal

FINDING = "struct<kind:string,ord:int,start:int,end:int,text:string>"
_NONE = f"array<{FINDING}>"
INTENT_WINDOW = 80


def matches_sql(text: str, pattern: Pattern) -> str:
    """SQL for the matched strings of one pattern, NULL where the cheap pre-check rules them out."""
    hits = f"regexp_extract_all({text}, {raw_literal(pattern.java)}, {pattern.group})"
    return hits if pattern.gate is None else f"case when {pattern.gate.sql(text)} then {hits} end"


def is_placeholder(value: Column) -> Column:
    """Values that stand for a hidden password and are not findings."""
    low = F.lower(value)
    return low.isin("xxx", "***", "<redacted>") | low.startswith("[") | low.startswith("<")


_LOCATED = "array<struct<start:int,end:int,text:string>>"


def _located_sql(text: str, matches: str, pattern: Pattern) -> str:
    found = f"case when size({matches}) > 0 then {located_sql(text, matches, pattern.java, pattern.group)} end"
    return f"coalesce({found}, cast(array() as {_LOCATED}))"


def _tag_sql(found: str, kind: str) -> str:
    return (f"transform({found}, (f__, o__) -> named_struct('kind', {raw_literal(kind)}, 'ord', o__, "
            "'start', f__.start, 'end', f__.end, 'text', f__.text))")


def _locate(text: str, matches: str, pattern: Pattern) -> Column:
    found = F.expr(_located_sql(text, matches, pattern))
    return found if pattern.validate is None else F.filter(found, lambda f: pattern.validate(f["text"]))


def _tag(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda f, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("ord"),
            f["start"].alias("start"), f["end"].alias("end"), f["text"].alias("text"),
        ),
    )


_PLACEHOLDER_SQL = "(lower({0}) in ('xxx', '***', '<redacted>') or startswith(lower({0}), '[') or startswith(lower({0}), '<'))"


def findings_sql(text: str, matches: Sequence[str], passwords: Sequence[str]) -> str:
    """SQL for the findings of the built-in patterns, whose matches the names hold, in scan order."""
    parts = []
    for name, pattern in zip(matches, BUILTIN, strict=True):
        found = _located_sql(text, name, pattern)
        if pattern.validate is luhn_valid:
            found = f"filter({found}, c__ -> {luhn_sql('c__.text')})"
        parts.append(_tag_sql(found, pattern.kind))
    both = ", ".join(_located_sql(text, name, pattern) for name, pattern in zip(passwords, PASSWORDS, strict=True))
    kept = f"filter(array_distinct(concat({both})), p__ -> not {_PLACEHOLDER_SQL.format('p__.text')})"
    return f"concat({', '.join([*parts, _tag_sql(kept, 'password')])})"


def with_findings(
    df: DataFrame,
    text: str,
    kinds: Iterable[str] | None = None,
    patterns: Sequence[Pattern] = BUILTIN,
    passwords: bool = True,
    out: str = "findings",
) -> DataFrame:
    """Add an array of findings in scan order (pattern by pattern, then by position).

    Overlapping findings of different kinds are all kept.  ``kinds`` prunes the patterns
    before the plan is built, so kinds nobody asks for cost nothing.  ``ord`` counts the
    findings of one kind in one text from 0.
    """
    wanted = None if kinds is None else set(kinds)
    active = [p for p in patterns if wanted is None or p.kind in wanted]
    use_pw = passwords and (wanted is None or "password" in wanted)
    t = f"`{text}`"
    # Two projections: matches first, then offsets, so each pattern runs once on texts
    # without hits and the offset work happens only where there are some.
    cols = [F.expr(matches_sql(t, p)).alias(f"__m{i}") for i, p in enumerate(active)]
    if use_pw:
        cols += [F.expr(matches_sql(t, p)).alias(f"__w{i}") for i, p in enumerate(PASSWORDS)]
    staged = df.select("*", *cols)
    parts = [
        _tag(_locate(t, f"__m{i}", p), p.kind)
        for i, p in enumerate(active)
    ]
    if use_pw:
        both = F.concat(*[_locate(t, f"__w{i}", p) for i, p in enumerate(PASSWORDS)])
        kept = F.filter(F.array_distinct(both), lambda f: ~is_placeholder(f["text"]))
        parts.append(_tag(kept, "password"))
    if not parts:
        return df.withColumn(out, F.array().cast(_NONE))
    temp = [f"__m{i}" for i in range(len(active))] + [f"__w{i}" for i in range(len(PASSWORDS) * use_pw)]
    hit = F.lit(False)
    for name in temp:
        hit = hit | (F.coalesce(F.size(name), F.lit(0)) > 0)
    value = F.when(hit, F.concat(*[p.cast(_NONE) for p in parts])).otherwise(F.array().cast(_NONE))
    return staged.withColumn(out, value).drop(*temp)


def findings(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    kinds: Iterable[str] | None = None,
    patterns: Sequence[Pattern] = BUILTIN,
    passwords: bool = True,
) -> DataFrame:
    """Long table: keys, seq (scan order in the text), kind, ord, start, end, text."""
    scanned = with_findings(df.select(*keys, F.col(text).alias("__text")), "__text", kinds, patterns, passwords)
    return explode_findings(scanned, keys)


def explode_findings(scanned: DataFrame, keys: Sequence[str], array: str = "findings") -> DataFrame:
    """One row per finding.

    The outer form matters: for an inner explode the optimizer infers ``size(array) > 0``
    and pushes it to the scan, which would run every pattern twice.
    """
    rows = scanned.select(*keys, F.posexplode_outer(array).alias("seq", "f")).filter(F.col("f").isNotNull())
    return rows.select(*keys, "seq", "f.kind", "f.ord", "f.start", "f.end", "f.text")


def detect(df: DataFrame, keys: Sequence[str], text: str, kind: str) -> DataFrame:
    """Findings of one kind."""
    return findings(df, keys, text, kinds=[kind]).drop("seq")


def scan_all(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Every kind in the fixed order, passwords last."""
    return findings(df, keys, text)


def union_findings(*tables: DataFrame) -> DataFrame:
    """Rows of several detectors one after the other (U1)."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def looks_intentional(text: Column, start: Column, end: Column) -> Column:
    """Whether the 80 bytes around [start, end) speak of a credential given on purpose."""
    size = F.octet_length(text)
    lo = F.greatest(start - INTENT_WINDOW, F.lit(0))
    hi = F.least(end + INTENT_WINDOW, size)
    around = F.lower(byte_slice(text, lo, hi))
    found = F.lit(False)
    for phrase in INTENT_PHRASES:
        found = found | F.rlike(around, F.lit(to_java(phrase, ("start", "end"))))
    valid = (start >= 0) & (end <= size) & (start <= end)
    return F.when(valid, found).otherwise(F.lit(False))


def count_by_kind(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def scan_status(scanned: DataFrame, keys: Sequence[str], array: str = "findings") -> DataFrame:
    """One row per text: number of findings and whether the scan counts as failed."""
    n = F.size(array)
    return scanned.select(*keys, n.alias("n_findings"), (n > 0).alias("failed"))


def summarize_kinds(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``kind=count`` pairs in kind order. Counting first keeps the list at one item per kind."""
    pairs = F.concat_ws("=", "kind", "n")
    return (
        count_by_kind(found, keys)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(pairs)), ",").alias("kinds"))
    )


def scan_totals(scanned: DataFrame, array: str = "findings") -> DataFrame:
    return scanned.agg(
        F.count("*").alias("scanned"), F.coalesce(F.sum(F.size(array)), F.lit(0)).cast("bigint").alias("findings")
    )
