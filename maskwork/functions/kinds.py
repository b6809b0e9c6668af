"""Facts about finding kinds, as Column expressions over a kind column.

The tables are fixed and tiny, so they are literal CASE expressions: no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.functions.patterns import KIND_ORDER

# Tier, default action, marker, bucket and label per kind.
SECRET_KINDS = ("api_key", "aws_key", "github_token", "private_key", "password")
PII_KINDS = ("email", "phone", "ssn", "credit_card", "person_name")
HIGH_TIER = ("api_key", "aws_key", "github_token", "private_key", "credit_card", "password")
MEDIUM_TIER = ("ssn",)
REDACTED_BY_DEFAULT = ("ssn", "email", "phone")
MARKED_KINDS = ("api_key", "aws_key", "github_token", "private_key", "password", "credit_card")
ALL_KINDS = KIND_ORDER + ("person_name",)
LABELS = {
    "ssn": "US Social Security number",
    "credit_card": "credit card number",
    "email": "email address",
    "api_key": "API key",
    "aws_key": "AWS access key",
    "github_token": "GitHub token",
    "private_key": "PEM private key",
}
ACTIONS = ("allow", "warn", "redact", "block", "redact_one_way")


def choose(key: Column, table: dict[str, str], default: Column | None) -> Column:
    """CASE over a small fixed table."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr if default is None else expr.otherwise(default)


def tier(kind: Column) -> Column:
    return F.when(kind.isin(*HIGH_TIER), "high").when(kind.isin(*MEDIUM_TIER), "medium").otherwise("low")


def default_action(kind: Column) -> Column:
    return (
        F.when(kind.isin(*HIGH_TIER), "redact_one_way")
        .when(kind.isin(*REDACTED_BY_DEFAULT), "redact")
        .otherwise("allow")
    )


def parse_action(name: Column) -> Column:
    return (
        F.when(name.isin(*ACTIONS), name)
        .when(name.isin("mask", "one_way"), "redact_one_way")
        .otherwise("unknown")
    )


def static_marker(kind: Column) -> Column:
    return F.when(kind.isin(*MARKED_KINDS), F.concat(F.lit("[REDACTED_"), F.upper(kind), F.lit("]"))).otherwise(
        "[REDACTED]"
    )


def bucket(kind: Column) -> Column:
    return F.when(kind.isin(*SECRET_KINDS), "secret").when(kind.isin(*PII_KINDS), "pii").otherwise("other")


def classify_kinds(kinds: Column) -> Column:
    """struct<had_secret, had_pii> of an array of kinds."""

    def overlaps(names: tuple[str, ...]) -> Column:
        return F.coalesce(F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names])), F.lit(False))

    return F.struct(overlaps(SECRET_KINDS).alias("had_secret"), overlaps(PII_KINDS).alias("had_pii"))


def label(kind: Column) -> Column:
    """Human name of a kind; kinds without one keep their own."""
    return choose(kind, LABELS, kind)


def kinds_table(spark: SparkSession) -> DataFrame:
    """The same facts as a dimension table."""
    base = spark.createDataFrame([(i + 1, k) for i, k in enumerate(ALL_KINDS)], "ord int, kind string")
    k = F.col("kind")
    return base.select(
        "ord", "kind", tier(k).alias("tier"), default_action(k).alias("default_action"),
        static_marker(k).alias("marker"), bucket(k).alias("bucket"), label(k).alias("label"),
    )
