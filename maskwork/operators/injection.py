"""Prompt-injection scoring by weighted rules."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.functions.patterns import to_java
from maskwork.operators.ordering import last_user_turn

DEFAULT_THRESHOLD = 50


@dataclass(frozen=True)
class InjectionRule:
    """A pattern over lower-cased text. ``hints`` are strings of which every match holds one."""

    rule_id: str
    weight: int
    pattern: str
    hints: tuple[str, ...] = ()


# The built-in rules (ids, weights and patterns must equal the specified ones).
BUILTIN_RULES: tuple[InjectionRule, ...] = (
    InjectionRule(
        "override.ignore_previous", 50,
        r"\b(ignore|disregard|forget)\b[^.!?\n]{0,40}\b(previous|prior|earlier|above|all)\b[^.!?\n]{0,40}\b(instructions?|prompts?|rules?|directives?|context)\b",
        ("ignore", "disregard", "forget")),
    InjectionRule(
        "override.new_instructions", 40,
        r"\b(new|following|updated)\s+instructions?\b[^.!?\n]{0,40}\b(replace|override|supersede)\b",
        ("instruction",)),
    InjectionRule(
        "override.role_override", 40,
        r"\byou\s+are\s+(now|actually|really)\s+(a|an|the)?\s*\w+",
        ("now", "actually", "really")),
    InjectionRule(
        "exfil.reveal_system", 50,
        r"\b(reveal|show|print|display|output|repeat|dump)\b[^.!?\n]{0,40}\b(system|initial|hidden|secret|internal)\b[^.!?\n]{0,40}\b(prompts?|instructions?|messages?|rules?)\b",
        ("prompt", "instruction", "message", "rule")),
    InjectionRule(
        "exfil.what_are_your_instructions", 35,
        r"\bwhat\s+(are|were)\s+your\s+(original|initial|system|hidden)\b",
        ("what",)),
    InjectionRule(
        "exfil.verbatim", 40,
        r"\b(repeat|print)\b[^.!?\n]{0,40}\b(verbatim|word\s*for\s*word|exactly)\b",
        ("verbatim", "word", "exactly")),
    InjectionRule(
        "jailbreak.dan", 40,
        r"\b(do\s+anything\s+now|dan\s+mode|developer\s+mode|jailbroken?)\b",
        ("anything", "dan", "developer", "jailbroke")),
    InjectionRule(
        "jailbreak.pretend", 50,
        r"\b(pretend|imagine|roleplay|role-play)\b[^.!?\n]{0,40}\b(no\s+(rules|restrictions|filters|guidelines)|without\s+(rules|restrictions|filters|guidelines))\b",
        ("pretend", "imagine", "roleplay", "role-play")),
    InjectionRule(
        "jailbreak.hypothetical_evil", 30,
        r"\b(hypothetical(?:ly)?|for\s+educational\s+purposes)\b[^.!?\n]{0,80}\b(illegal|harmful|dangerous|malicious|weapon|exploit)\b",
        ("hypothetical", "educational")),
    InjectionRule(
        "delimiter.fake_system", 35,
        r"(<\|(?:system|im_start|start_header_id)\|>|<<sys>>|\[\[system]])",
        ("<|", "<<sys>>", "[[system]")),
    InjectionRule(
        "delimiter.role_json", 30,
        r'"role"\s*:\s*"(system|assistant)"',
        ('"role"',)),
    InjectionRule(
        "bypass.ignore_safety", 40,
        r"\b(ignore|bypass|override|disable)\b[^.!?\n]{0,40}\b(safety|content|ethical|moral)\b[^.!?\n]{0,40}\b(policy|policies|filter|filters|guidelines|rules)\b",
        ("ignore", "bypass", "override", "disable")),
    InjectionRule(
        "tool.exfil_call", 30,
        r"\b(send|post|upload|leak|exfiltrate)\b[^.!?\n]{0,30}\b(to|the)\b[^.!?\n]{0,30}\bhttp[s]?://",
        ("http",)),
    InjectionRule(
        "encoding.base64_instruction", 15,
        r"\b(decode|base64|rot13)\b[^.!?\n]{0,40}\b(instructions?|prompt|command)\b",
        ("decode", "base64", "rot13")),
)


def register_injection_rule(
    rules: Sequence[InjectionRule], rule_id: str, weight: int, pattern: str
) -> tuple[InjectionRule, ...]:
    """The rules with one more at the end."""
    return tuple(rules) + (InjectionRule(rule_id, weight, pattern),)


def rules_table(spark: SparkSession, rules: Sequence[InjectionRule] = BUILTIN_RULES) -> DataFrame:
    rows = [(i, r.rule_id, r.weight, r.pattern) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, rule_id string, weight int, pattern string")


def _edges(pattern: str, builtin: bool) -> tuple[str, ...]:
    """Kind of each boundary. In the built-in rules every boundary stands at a word's edge."""
    if not builtin:
        return ()
    tails = pattern.split(r"\b")[1:]
    return tuple("end" if t == "" or t.startswith(("[^", r"\s")) else "start" for t in tails)


def matched_rules(lower: Column, rules: Sequence[InjectionRule]) -> Column:
    """array<struct<rule_ord,rule_id,weight>> in rule order, each rule at most once."""
    items = []
    for i, r in enumerate(rules):
        hit = F.rlike(lower, F.lit(to_java(r.pattern, _edges(r.pattern, r in BUILTIN_RULES))))
        if r.hints:
            gate = F.lit(False)
            for h in r.hints:
                gate = gate | F.contains(lower, F.lit(h))
            hit = gate & hit
        rule = F.struct(F.lit(i).alias("rule_ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.weight).alias("weight"))
        items.append(F.when(hit, rule))
    return F.array_compact(F.array(*items))


def with_matches(df: DataFrame, text: str, rules: Sequence[InjectionRule] = BUILTIN_RULES, out: str = "matches") -> DataFrame:
    """Add the matched rules of each text. The lower-cased text is made once."""
    low = df.withColumn("__low", F.lower(text))
    return low.withColumn(out, matched_rules(F.col("__low"), rules)).drop("__low")


def injection_matches(
    parts: DataFrame, keys: Sequence[str], text: str, rules: Sequence[InjectionRule] = BUILTIN_RULES
) -> DataFrame:
    """One row per matched rule and part: keys, rule_ord, rule_id, weight."""
    scored = with_matches(parts.select(*keys, F.col(text).alias("__text")), "__text", rules)
    rows = scored.select(*keys, F.explode_outer("matches").alias("m")).filter(F.col("m").isNotNull())
    return rows.select(*keys, "m.rule_ord", "m.rule_id", "m.weight")


def score_of(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0), lambda acc, m: acc + m["weight"])


def rule_ids(matches: Column) -> Column:
    return F.array_join(F.transform(matches, lambda m: m["rule_id"]), ",")


def score_text(df: DataFrame, text: str, rules: Sequence[InjectionRule] = BUILTIN_RULES) -> DataFrame:
    """Add ``score`` and ``rules`` (ids in rule order) for a stand-alone text."""
    scored = with_matches(df, text, rules)
    return (
        scored.withColumn("score", score_of(F.col("matches")))
        .withColumn("rules", rule_ids(F.col("matches")))
        .drop("matches")
    )


def injection_score(
    parts: DataFrame,
    request: str,
    role: str,
    msg: str,
    text: str,
    rules: Sequence[InjectionRule] = BUILTIN_RULES,
) -> DataFrame:
    """request, score, n_matches, rules over all user and tool turns.

    ``rules`` names each matched rule once, by first match; with repeats counted per rule the
    list stays as short as the rule table however many turns a request has.  Every single
    match is a row of ``injection_matches``.
    """
    seen = parts.filter(F.col(role).isin("user", "tool"))
    hits = injection_matches(seen, [request, msg], text, rules)
    per_rule = hits.groupBy(request, "rule_ord", "rule_id", "weight").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col(msg), F.col("rule_ord"))).alias("first")
    )
    ordered = F.array_sort(F.collect_list(F.struct("first", "rule_id")))
    summed = per_rule.groupBy(request).agg(
        F.sum(F.col("n") * F.col("weight")).alias("score"),
        F.sum("n").alias("n_matches"),
        F.array_join(F.transform(ordered, lambda x: x["rule_id"]), ",").alias("rules"),
    )
    zero = F.lit(0).cast("bigint")
    return parts.select(request).distinct().join(summed, request, "left").select(
        request, F.coalesce("score", zero).alias("score"), F.coalesce("n_matches", zero).alias("n_matches"),
        F.coalesce("rules", F.lit("")).alias("rules"),
    )


def injection_block(scores: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``blocked`` and the reason; a threshold of 0 or less means the default."""
    limit = threshold if threshold > 0 else DEFAULT_THRESHOLD
    hit = F.col("score") >= limit
    reason = F.concat(
        F.lit("injection score "), F.col("score").cast("string"), F.lit(f" >= threshold {limit} ["), F.col("rules"), F.lit("]")
    )
    return scores.withColumn("blocked", hit).withColumn("reason", F.when(hit, reason).otherwise(F.lit("")))


def last_message_score(
    parts: DataFrame, request: str, role: str, msg: str, text: str, rules: Sequence[InjectionRule] = BUILTIN_RULES
) -> DataFrame:
    """Score of the newest user turn alone."""
    return score_text(last_user_turn(parts, request, msg, role, text), text, rules).drop(text)
