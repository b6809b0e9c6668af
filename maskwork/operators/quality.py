"""Row checks that split tables into good rows and rejected rows with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.classify import trim_space
from maskwork.functions.kinds import parse_action

MODES = ("unary", "streaming")
KNOWN_MODALITIES = ("text", "image", "audio", "video", "pdf", "archive", "office")
MAX_BODY_BYTES = 4 << 20


def request_problem(mode: Column, n_messages: Column, n_not_text: Column, n_unknown: Column) -> Column:
    """Why a request is rejected, NULL if it is fine."""
    return (
        F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), "mode not set")
        .when(F.coalesce(n_messages, F.lit(0)) == 0, "no messages")
        .when(F.coalesce(n_unknown, F.lit(0)) > 0, "unknown modality")
        .when(F.coalesce(n_not_text, F.lit(0)) > 0, "modality not supported")
    )


def validate_requests(requests: DataFrame, parts: DataFrame, request: str) -> DataFrame:
    """Add ``problem`` to each request from its mode and its parts' modalities."""
    m = F.col("modality")
    per = parts.groupBy(request).agg(
        F.count("*").alias("__n"),
        F.count_if(m.isin(*KNOWN_MODALITIES) & (m != "text")).alias("__other"),
        F.count_if(~F.coalesce(m.isin(*KNOWN_MODALITIES), F.lit(False))).alias("__unknown"),
    )
    problem = request_problem(F.col("mode"), F.col("__n"), F.col("__other"), F.col("__unknown"))
    return requests.join(per, request, "left").withColumn("problem", problem).drop("__n", "__other", "__unknown")


def body_problem(body: Column, max_bytes: int = MAX_BODY_BYTES) -> Column:
    return F.when(F.octet_length(body) > max_bytes, "request too large")


def split_rejected(df: DataFrame, problem: str = "problem") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(problem).isNull()).drop(problem), df.filter(F.col(problem).isNotNull())


def provider_problems(api_key: Column, api_key_env: Column, kind: Column) -> Column:
    """Array of what is wrong with a provider row."""
    return F.array_compact(F.array(
        F.when(F.coalesce(api_key, F.lit("")) != "", "inline api_key"),
        F.when(F.coalesce(api_key_env, F.lit("")) == "", "missing api_key_env"),
        F.when(~F.coalesce(kind.isin("openai", "anthropic"), F.lit(False)), "unknown kind"),
    ))


def principal_problem(key: Column) -> Column:
    return F.when(~F.coalesce(key.startswith("sk-gw-"), F.lit(False)), "key must be sk-gw-*")


def action_problem(action: Column) -> Column:
    return F.when(parse_action(action) == "unknown", "unknown action")


def provider_slug(name: Column) -> Column:
    """Normalised provider id, NULL if it is empty or has other characters."""
    p = F.lower(trim_space(name))
    return F.when(F.rlike(p, F.lit(r"\A[a-z0-9_-]+\z")), p)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def kind_set(found: DataFrame, request: str) -> DataFrame:
    """Sorted distinct kinds per request."""
    return (
        found.select(request, "kind").distinct().groupBy(request)
        .agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))
    )
