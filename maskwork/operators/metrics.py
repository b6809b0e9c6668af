"""Counters, histograms and reports over the audit and metric tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwork.functions.kinds import bucket, classify_kinds, tier
from maskwork.operators.ordering import recent
from maskwork.operators.ranking import running_sum

# Verdicts, histogram bounds and service targets.
VERDICTS = ("allowed", "redacted", "warned", "blocked_dlp", "blocked_policy", "auth_failed", "upstream_error")
DURATION_BUCKETS = (0.001, 0.002, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
SIZE_BUCKETS = (128.0, 512.0, 2048.0, 8192.0, 32768.0, 131072.0, 524288.0, 2097152.0, 8388608.0)
SECRET_MINUTES, INJECTION_MINUTES = 5, 15
SMALL_BYTES, MEDIUM_BYTES = 8 * 1024, 64 * 1024


def verdict_counts(audit: DataFrame, ts: str, tie: str, capacity: int | None = None) -> DataFrame:
    """Counts per verdict, over the newest ``capacity`` entries if given; anything else is an error."""
    newest = recent(audit.select(ts, tie, "verdict"), ts, tie, capacity) if capacity else audit
    v = F.col("verdict")
    known = v.isin(*VERDICTS)
    return newest.agg(
        *[F.count_if(v == name).alias(name) for name in VERDICTS],
        F.count_if(~F.coalesce(known, F.lit(False))).alias("errors"),
        F.count("*").alias("buffered"),
    )


def lifetime_counters(audit: DataFrame, kinds: str = "dlp_findings") -> DataFrame:
    """total, secrets_caught, pii_redacted (one per entry each) and injections_blocked."""
    c = audit.withColumn("__c", classify_kinds(F.col(kinds)))
    blocked = F.col("verdict").isin("blocked_dlp", "blocked_policy") & (F.col("injection_score") > 0)
    return c.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("__c.had_secret")).alias("secrets_caught"),
        F.count_if(F.col("__c.had_pii")).alias("pii_redacted"),
        F.count_if(blocked).alias("injections_blocked"),
    )


def time_saved_seconds(secrets: Column, injections: Column) -> Column:
    return (secrets * SECRET_MINUTES + injections * INJECTION_MINUTES) * 60


def counters(samples: DataFrame, dims: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return samples.groupBy(name, *dims).agg(F.sum(value).alias("total"))


def label_conflicts(samples: DataFrame, name: str = "name", dims: str = "dims") -> DataFrame:
    """Metrics whose label keys change: name and the number of different key sets."""
    keys = F.array_join(F.array_sort(F.map_keys(dims)), ",")
    sets = samples.select(name, keys.alias("keys")).distinct()
    return sets.groupBy(name).agg(F.count("*").alias("n_label_sets")).filter(F.col("n_label_sets") > 1)


def histogram(df: DataFrame, dims: Sequence[str], value: str, bounds: Sequence[float] = DURATION_BUCKETS) -> DataFrame:
    """Cumulative buckets in long form: dims, le, bucket_count, total_count, total_sum.

    One conditional count per bound in a single aggregation; the bounds are a constant list.
    """
    v = F.col(value)
    agg = df.groupBy(*dims).agg(
        *[F.count_if(v <= b).alias(f"__b{i}") for i, b in enumerate(bounds)],
        F.count(v).alias("total_count"), F.sum(v).alias("total_sum"),
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total_count").alias("bucket_count")))
    return agg.select(*dims, F.explode(F.array(*rows)).alias("b"), "total_count", "total_sum").select(
        *dims, "b.le", "b.bucket_count", "total_count", "total_sum"
    )


def gauge_last(samples: DataFrame, dims: Sequence[str], us: str, tie: str, value: str) -> DataFrame:
    return samples.groupBy(*dims).agg(F.max_by(value, F.struct(F.col(us), F.col(tie))).alias("last_value"))


def gauge_levels(samples: DataFrame, dims: Sequence[str], us: str, delta: str, bucket_us: int = 60_000_000) -> DataFrame:
    """Level at the end of each time bucket for gauges that are added to and taken from."""
    per = samples.select(*dims, F.floor(F.col(us) / bucket_us).cast("bigint").alias("bucket"), F.col(delta).alias("d"))
    return running_sum(per, dims, "bucket", "d", out="level")


def stage_latency(stages: DataFrame, stage: str = "stage", outcome: str = "outcome", seconds: str = "seconds") -> DataFrame:
    """Histogram of stage durations per stage and outcome."""
    return histogram(stages, [stage, outcome], seconds)


def stage_errors(stages: DataFrame, stage: str = "stage", outcome: str = "outcome") -> DataFrame:
    return stages.groupBy(stage).agg(F.count_if(F.col(outcome) != "success").alias("errors"), F.count("*").alias("runs"))


def usage_totals(usage: DataFrame, dims: Sequence[str]) -> DataFrame:
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return usage.groupBy(*dims).agg(
        F.sum(i).alias("input_tokens"), F.sum(o).alias("output_tokens"), F.sum(i + o).alias("total_tokens")
    )


def findings_by_kind(found: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Findings per kind with tier and bucket, per extra dimension if given."""
    k = F.col("kind")
    counted = found.groupBy(*dims, "kind").agg(F.count("*").alias("n"))
    return counted.select(*dims, "kind", tier(k).alias("tier"), bucket(k).alias("bucket"), "n")


def findings_rollup(found: DataFrame, dim: str) -> DataFrame:
    """Counts per (dim, kind) with totals per dim and over all, marked by NULLs."""
    return found.rollup(dim, "kind").agg(F.count("*").alias("n"))


def series_count(samples: DataFrame, columns: Sequence[str], warn: int = 40_000, refuse: int = 50_000) -> DataFrame:
    """Distinct label combinations and where they stand against the budget."""
    n = samples.select(*columns).distinct().agg(F.count("*").alias("series"))
    state = F.when(F.col("series") >= refuse, "refuse").when(F.col("series") >= warn, "warn").otherwise("ok")
    return n.withColumn("state", state)


def payload_class(n_bytes: Column) -> Column:
    return F.when(n_bytes <= SMALL_BYTES, "S").when(n_bytes <= MEDIUM_BYTES, "M").otherwise("L")


def latency_quantiles(df: DataFrame, dims: Sequence[str], ms: str, quantiles: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Exact nearest-rank quantiles of integer milliseconds, one column per quantile.

    Values are counted first, so the ordered pass sees one row per distinct millisecond.
    """
    counted = df.groupBy(*dims, ms).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*dims).orderBy(ms).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__cum", F.sum("n").over(up)).withColumn(
        "__all", F.sum("n").over(Window.partitionBy(*dims))
    )
    picks = [
        F.min(F.when(F.col("__cum") >= F.ceil(F.col("__all") * F.lit(q)), F.col(ms))).alias(f"p{round(q * 100)}")
        for q in quantiles
    ]
    return ranked.groupBy(*dims).agg(F.sum("n").alias("requests"), *picks)


def slo_report(requests: DataFrame, n_bytes: str, total_ms: str, upstream_ms: str) -> DataFrame:
    """Overhead p95 and p99 per payload class against the targets."""
    base = requests.select(
        payload_class(F.col(n_bytes)).alias("class"), (F.col(total_ms) - F.col(upstream_ms)).alias("overhead_ms")
    )
    out = latency_quantiles(base, ["class"], "overhead_ms")
    c = F.col("class")
    p95 = F.when(c == "S", 20).when(c == "M", 60).otherwise(200)
    p99 = F.when(c == "S", 40).when(c == "M", 120).otherwise(500)
    return out.withColumn("met", (F.col("p95") <= p95) & (F.col("p99") <= p99))


def success_rate(requests: DataFrame, us: str, outcome: str, days: int = 30) -> DataFrame:
    """day, rate over the rolling window of ``days`` without client errors, and whether 99.5 % is met."""
    day = F.floor(F.col(us) / 86_400_000_000).cast("bigint").alias("day")
    o = F.col(outcome)
    per = requests.filter(o != "client_error").groupBy(day).agg(
        F.count_if(o == "success").alias("ok"), F.count("*").alias("n")
    )
    w = Window.orderBy("day").rangeBetween(-(days - 1), 0)
    rate = F.sum("ok").over(w) / F.sum("n").over(w)
    return per.select("day", rate.alias("rate")).withColumn("met", F.col("rate") >= 0.995)
