"""Candidate health, routing by policies and rule tables."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from typing import Iterator, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwork.functions.classify import send_failed, trim_space
from maskwork.functions.kinds import ALL_KINDS, parse_action

MIN_SENDS = 10


@dataclass(frozen=True)
class Policy:
    """A routing policy: a Spark SQL predicate over request columns and ``candidate``, whose first hit is picked, or a
    ``verdict``, an expression over request columns that names an upstream."""

    policy_id: str
    predicate: str = ""
    verdict: str = ""


# The shipped policies and providers.
SHIPPED_POLICIES = (
    Policy(
        "anthropic-by-model-v1",
        "startswith(model, 'claude') and candidate.kind = 'anthropic' and candidate.health = 'healthy'",
    ),
    Policy("openai-default-v1", "candidate.kind = 'openai' and candidate.health = 'healthy'"),
)
PROVIDERS = (
    # pos, id, kind, model, max_context, cost per 1k in, cost per 1k out
    (0, "openai-default", "openai", "gpt-4o-mini", 128000, 0.15, 0.6),
    (1, "ollama-local", "openai", "llama3.2:1b", 8192, 0.0, 0.0),
    (2, "anthropic-default", "anthropic", "claude-3-5-sonnet-20241022", 200000, 3.0, 15.0),
)
PROVIDER_SCHEMA = "pos int, id string, kind string, model string, max_context int, cost_in double, cost_out double"


def request_features(parts: DataFrame, request: str, text: str, modality: str = "modality") -> DataFrame:
    """request, parts_count, total_bytes, text_char_count (bytes), modalities (sorted).

    Modalities are a closed list, so flags stand in for collecting a set.
    """
    size = F.octet_length(text).cast("bigint")
    names = ("archive", "audio", "image", "office", "pdf", "text", "video")
    flags = [F.max(F.when(F.col(modality) == n, F.lit(n))) for n in names]
    return parts.groupBy(request).agg(
        F.count("*").alias("parts_count"),
        F.sum(size).alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col(modality) == "text", size)), F.lit(0)).alias("text_char_count"),
        F.array_join(F.array_compact(F.array(*flags)), ",").alias("modalities"),
    )


def health(n_sends: Column, n_errors: Column) -> Column:
    """Healthy below ten sends; above half errors unavailable, above a tenth degraded."""
    rate = n_errors / n_sends
    return (
        F.when(n_sends < MIN_SENDS, "healthy")
        .when(rate > 0.5, "unavailable")
        .when(rate > 0.1, "degraded")
        .otherwise("healthy")
    )


def upstream_health(sends: DataFrame, upstream: str, status: str, net_error: str) -> DataFrame:
    failed = send_failed(F.col(status), F.col(net_error))
    counted = sends.groupBy(upstream).agg(F.count("*").alias("n_sends"), F.count_if(failed).alias("n_errors"))
    return counted.withColumn("health", health(F.col("n_sends"), F.col("n_errors")))


def _candidate(provider: tuple, n: Column, e: Column) -> Column:
    pos, pid, kind, _, max_context, cost_in, cost_out = provider
    return F.struct(
        F.lit(pos).alias("pos"), F.lit(pid).alias("id"), F.lit(kind).alias("kind"), health(n, e).alias("health"),
        F.lit("sse").alias("streaming"), F.lit(max_context).alias("max_context"),
        F.lit(cost_in).alias("cost_in"), F.lit(cost_out).alias("cost_out"),
        F.when(n > 0, e / n).otherwise(0.0).alias("error_rate"),
    )


def snapshots(
    sends: DataFrame, upstream: str, status: str, net_error: str, period: str, providers: Sequence[tuple] = PROVIDERS
) -> DataFrame:
    """Candidates frozen at the start of each period: snapshot, candidates.

    ``period`` is an integer column of the send log.  Health at a period counts all earlier
    sends.  The providers are configuration, so each is a pair of conditional counts: one
    small row per period, and a running sum over those rows.
    """
    failed = send_failed(F.col(status), F.col(net_error))
    counts = []
    for pos, pid, *_ in providers:
        mine = F.col(upstream) == pid
        counts += [F.count_if(mine).alias(f"__n{pos}"), F.count_if(mine & failed).alias(f"__e{pos}")]
    per = sends.groupBy(F.col(period).alias("snapshot")).agg(*counts)
    before = Window.orderBy("snapshot").rowsBetween(Window.unboundedPreceding, -1)
    entries = []
    for p in providers:
        n = F.coalesce(F.sum(f"__n{p[0]}").over(before), F.lit(0).cast("bigint"))
        e = F.coalesce(F.sum(f"__e{p[0]}").over(before), F.lit(0).cast("bigint"))
        entries.append(_candidate(p, n, e))
    return per.select("snapshot", F.array(*entries).alias("candidates"))


@contextmanager
def _null_for_errors(spark: SparkSession) -> Iterator[None]:
    """Expressions that are analyzed inside give NULL for a failed cast, a division by zero or a missing element."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _pick(policy: Policy, candidates: str) -> tuple[str, str]:
    """SQL for the id a policy picks and for whether it is in error."""
    if policy.verdict:
        return f"get(filter({candidates}, candidate -> candidate.id = ({policy.verdict})), 0).id", f"({policy.verdict}) is null"
    wrong = f"exists({candidates}, candidate -> ({policy.predicate}) is null)"
    return f"case when not {wrong} then get(filter({candidates}, candidate -> {policy.predicate}), 0).id end", wrong


def route(requests: DataFrame, policies: Sequence[Policy] = SHIPPED_POLICIES, candidates: str = "candidates") -> DataFrame:
    """Add upstream, policy, trace, policy_errors and route_error.

    The first policy that picks a candidate wins; the trace lists the policies tried.  Each
    row carries its frozen candidate array, so routing is a projection and builds no pairs.

    A policy fails alone: one that names an unknown column or does not parse fails for every request, one whose predicate is
    NULL for some candidate (a missing value, a failed cast, a division by zero) for that request. A failed policy and a
    verdict that names no candidate are passed over; ``policy_errors`` lists the failed ones among those tried. Whole
    numbers that overflow inside a predicate wrap.
    """
    picks, step = [], requests
    with _null_for_errors(requests.sparkSession):
        for i, p in enumerate(policies):
            pick, wrong = _pick(p, candidates)
            try:
                step = step.withColumns({f"__pick{i}": F.expr(pick), f"__wrong{i}": F.coalesce(F.expr(wrong), F.lit(False))})
            except (AnalysisException, ParseException):
                step = step.withColumns({f"__pick{i}": F.lit(None).cast("string"), f"__wrong{i}": F.lit(True)})
            picks.append(f"__pick{i}")
    ids = [p.policy_id for p in policies]
    chosen = F.coalesce(*[F.col(n) for n in picks])
    policy, trace = None, None
    for i, n in enumerate(picks):
        cond = F.col(n).isNotNull()
        tried = F.lit(",".join(ids[: i + 1]))
        policy = F.when(cond, F.lit(ids[i])) if policy is None else policy.when(cond, F.lit(ids[i]))
        trace = F.when(cond, tried) if trace is None else trace.when(cond, tried)
    empty = F.coalesce(F.size(candidates), F.lit(0)) <= 0
    # a policy behind the chosen one is not tried
    failed = [F.when(F.col(f"__wrong{i}") & (F.coalesce(*[F.col(n) for n in picks[:i]], F.lit(None).cast("string")).isNull()), F.lit(ids[i]))
              for i in range(len(ids))]
    return (
        step.withColumn("upstream", chosen)
        .withColumn("policy", policy)
        .withColumn("trace", F.when(empty, F.lit("")).otherwise(trace.otherwise(F.lit(",".join(ids)))))
        .withColumn("policy_errors", F.when(empty, F.lit("")).otherwise(F.concat_ws(",", *failed)))
        .withColumn("route_error", F.when(chosen.isNull(), F.lit("cap_mismatch")))
        .drop(*picks, *[f"__wrong{i}" for i in range(len(ids))])
    )


def snapshots_as_of(
    requests: DataFrame, sends: DataFrame, us: str, upstream: str, status: str, net_error: str,
    providers: Sequence[tuple] = PROVIDERS, slice_us: int = 3_600_000_000
) -> DataFrame:
    """Requests with ``candidates`` as they stood at each request's own time, sends of that very time included.

    An as-of join by a union: sends and requests run in one order of time, and every request carries the counts so far.
    Time is cut into slices; a slice's totals are one small row, summed over the slices before, and inside a slice
    the counts run on. So no provider is ever sorted as a whole, and a slice is one task. A request without a time has all
    providers without a send.
    """
    failed = F.coalesce(send_failed(F.col(status), F.col(net_error)), F.lit(False))
    zero = F.lit(0).cast("bigint")
    marks = [f(pos, pid) for pos, pid, *_ in providers for f in (
        lambda pos, pid: (f"__n{pos}", F.col(upstream) == pid), lambda pos, pid: (f"__e{pos}", (F.col(upstream) == pid) & failed))]
    names = [n for n, _ in marks]
    moved = sends.where(F.col(us).isNotNull()).select(
        F.col(us).alias("__us"), F.lit(0).alias("__turn"), F.lit(None).cast(StructType(requests.schema.fields)).alias("__row"),
        *[F.coalesce(m.cast("bigint"), zero).alias(n) for n, m in marks])
    asked = requests.where(F.col(us).isNotNull()).select(
        F.col(us).alias("__us"), F.lit(1).alias("__turn"), F.struct(*requests.columns).alias("__row"), *[zero.alias(n) for n in names])
    slice_ = F.floor(F.col("__us") / slice_us).cast("bigint").alias("__slice")
    totals = moved.groupBy(slice_).agg(*[F.sum(n).alias(n) for n in names]).union(
        asked.select(slice_).distinct().select("__slice", *[zero.alias(n) for n in names])).groupBy("__slice").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__slice", *[F.coalesce(F.sum(n).over(before), zero).alias(f"{n}b") for n in names])
    inside = Window.partitionBy("__slice").orderBy(F.struct("__us", "__turn"))
    run = moved.union(asked).withColumn("__slice", slice_).select(
        "__slice", "__row", "__turn", *[F.sum(n).over(inside).alias(n) for n in names]).where("__turn = 1")
    counted = run.join(bases, "__slice").select("__row", *[(F.col(n) + F.col(f"{n}b")).alias(n) for n in names])
    alone = requests.where(F.col(us).isNull()).select(F.struct(*requests.columns).alias("__row"), *[zero.alias(n) for n in names])
    entries = [_candidate(p, F.col(f"__n{p[0]}"), F.col(f"__e{p[0]}")) for p in providers]
    return counted.union(alone).select("__row.*", F.array(*entries).alias("candidates"))


def covers(required: Column, offered: Column) -> Column:
    """Whether every required modality is among the offered ones."""
    return F.size(F.array_except(required, offered)) == 0


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rule rows (idx, name, if, then) -> idx, name, target, kind, action, threshold, detail, error.

    target is dlp, default or injection; error is NULL for a good rule.
    """
    cond, action = trim_space(F.col("if")), trim_space(F.lower("then"))
    is_dlp = cond.startswith("detects ")
    kind = trim_space(F.regexp_replace(cond, "^detects ", ""))
    is_inj = cond.startswith("injection_score") & ~is_dlp
    rest = trim_space(F.regexp_replace(cond, "^injection_score", ""))
    at_least = rest.startswith(">=")
    above = rest.startswith(">") & ~at_least
    number = trim_space(F.regexp_replace(rest, "^>=?", ""))
    whole = F.when(F.rlike(number, F.lit(r"^[+-]?[0-9]+$")), number.try_cast("bigint"))
    act = parse_action(action)
    any_kind = kind.isin("any_pii", "any")
    error = (
        F.when((F.coalesce(cond, F.lit("")) == "") | (F.coalesce(action, F.lit("")) == ""), "incomplete")
        .when(is_dlp & (act == "unknown"), "unknown action")
        .when(is_dlp & ~any_kind & ~kind.isin(*ALL_KINDS), "unknown kind")
        .when(is_dlp, F.lit(None).cast("string"))
        .when(~is_inj, "unknown condition")
        .when(~at_least & ~above, "needs >= or >")
        .when(whole.isNull(), "threshold must be an integer")
        .when(action != "block", "only block")
    )
    threshold = F.when(at_least, whole).otherwise(whole + 1)
    target = F.when(is_dlp & any_kind, "default").when(is_dlp, "dlp").when(is_inj, "injection")
    detail = (
        F.when(F.col("target") == "default", F.concat(F.lit("DLP default = "), F.col("action")))
        .when(F.col("target") == "dlp", F.concat("kind", F.lit(" → "), F.col("action")))
        .otherwise(F.concat(F.lit("threshold ≥ "), F.col("threshold").cast("string"), F.lit(" → block")))
    )
    ok = error.isNull()
    return rules.select(
        "idx", "name",
        F.when(ok, target).alias("target"),
        F.when(ok & is_dlp & ~any_kind, kind).alias("kind"),
        F.when(ok & is_dlp, act).when(ok, F.lit("block")).alias("action"),
        F.when(ok & is_inj, threshold).alias("threshold"),
        F.concat(F.lit("if: "), F.col("if"), F.lit(" / then: "), F.col("then")).alias("original"),
        error.alias("error"),
    ).withColumn("detail", F.when(F.col("error").isNull(), detail))


def compiled_policy(compiled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, action) with the last rule of a kind, and one row (default_action, threshold)."""
    good = compiled.filter(F.col("error").isNull())
    actions = good.filter(F.col("target") == "dlp").groupBy("kind").agg(F.max_by("action", "idx").alias("action"))
    is_default = F.col("target") == "default"
    settings = good.agg(
        F.max_by(F.when(is_default, F.col("action")), F.when(is_default, F.col("idx"))).alias("default_action"),
        F.min("threshold").alias("threshold"),
    )
    return actions, settings


def merge_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """kind, action: the overlay's action where it has one, else the base's."""
    b = base.select("kind", F.col("action").alias("__base"))
    return b.join(overlay, "kind", "full_outer").select("kind", F.coalesce("action", "__base").alias("action"))


def cost_estimate(usage: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost per key: tokens times the price per thousand. Tokens are summed before the join."""
    summed = usage.groupBy(*keys, "upstream").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    priced = summed.join(prices.select(F.col("id").alias("upstream"), "cost_in", "cost_out"), "upstream")
    cost = F.col("input_tokens") / 1000 * F.col("cost_in") + F.col("output_tokens") / 1000 * F.col("cost_out")
    return priced.select(*keys, "upstream", "input_tokens", "output_tokens", cost.alias("cost"))
