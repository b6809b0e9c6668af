"""Log hygiene: control characters, secrets and sensitive fields."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.patterns import SECRET_IN_LOG
from maskwork.functions.text import byte_slice
from maskwork.session import materialise

MAX_BYTES = 1024
# Parts of field names that mark a field as sensitive, and the log levels.
SENSITIVE_WORDS = (
    "authorization", "cookie", "set-cookie", "api_key", "apikey", "api-key", "secret", "token",
    "password", "passwd", "x-api-key", "openai-api-key", "anthropic-api-key",
)
LEVELS = ("debug", "info", "warn", "error")
# One look at the first character spares most positions of a text the alternatives of SECRET_IN_LOG.
SECRET_START = "(?=[sAgx])"


def sanitize(text: Column) -> Column:
    """Cut at 1024 bytes, blank control characters, hide anything shaped like a secret."""
    cut = F.when(
        F.octet_length(text) > MAX_BYTES, F.concat(byte_slice(text, F.lit(0), F.lit(MAX_BYTES)), F.lit("…"))
    ).otherwise(text)
    return F.regexp_replace(F.regexp_replace(cut, r"[\x00-\x1f\x7f]", " "), SECRET_START + f"(?:{SECRET_IN_LOG})", "<redacted-secret>")


def is_sensitive(name: Column) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for word in SENSITIVE_WORDS:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def redact_secret(value: Column) -> Column:
    """Length and the first four hash bytes in place of a value."""
    return F.when(value == "", "<empty>").otherwise(F.concat(
        F.lit("<redacted len="), F.octet_length(value).cast("string"), F.lit(" sha256-first-8="),
        F.substring(F.sha2(value, 256), 1, 8), F.lit(">"),
    ))


def redact_field(name: Column, value: Column) -> Column:
    return F.when(is_sensitive(name), redact_secret(value)).otherwise(sanitize(value))


def redact_sensitive_fields(fields: Column) -> Column:
    """A map of string fields with each value redacted or sanitized."""
    return F.transform_values(fields, redact_field)


def redact_nested_fields(fields: Column) -> Column:
    """A map of maps, one level deeper: a sensitive outer name hides the whole inner map."""
    hidden = F.create_map(F.lit("value"), F.lit("<redacted>"))
    return F.transform_values(
        fields, lambda name, inner: F.when(is_sensitive(name), hidden).otherwise(redact_sensitive_fields(inner))
    )


def redact_variant_fields(logs: DataFrame, key: str, fields: str, skip: Sequence[str] = ("ts", "level", "msg")) -> DataFrame:
    """key, path, value (VARIANT): every leaf of the ``fields`` of each log, redacted, whatever their depth and type.

    A sensitive name at any depth hides its value: a string becomes its length and hash, all else, whole objects and
    lists too, ``<redacted>``. Other strings are sanitized, also inside lists; numbers, booleans and nulls keep their
    type; an empty object or list is a leaf. Paths read ``a.b[0]``. Top-level names in ``skip`` are left out. One pass per
    level of nesting, none with a shuffle; each level's open objects are written for the next one. ``logs`` has one
    row per log and a NULL gives no rows.
    """
    spark = logs.sparkSession
    # no filter on the fields: Spark would push it to the scan and parse every log twice, and a NULL gives no rows anyway
    open_ = logs.select(F.col(key).alias("k"), F.lit("").alias("path"), F.col(fields).alias("v"))
    done, depth = [], 0
    while True:
        inside = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", F.col("key").alias("name"), F.col("value").alias("x")))
        if not depth:
            inside = inside.where(~F.coalesce(F.col("name").isin(*skip), F.lit(False)))
        at = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(
            F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("."), "name"))
        schema = F.when(F.is_variant_null("x"), "VOID").otherwise(F.schema_of_variant("x"))
        kind = F.regexp_extract("schema", "^[A-Z]+", 0)
        text = F.when(F.col("kind") == "STRING", F.try_variant_get("x", "$", "string"))
        is_text, hidden = F.col("kind") == "STRING", F.col("hidden")
        # a list of nulls has the schema of an empty one
        empty = (F.col("schema") == "OBJECT<>") | ((F.col("schema") == "ARRAY<VOID>") & F.try_variant_get("x", "$[0]", "variant").isNull())
        level = inside.select("k", at.alias("path"), F.coalesce(is_sensitive(F.col("name")), F.lit(False)).alias("hidden"), "x", schema.alias("schema"))
        level = level.withColumn("kind", kind).withColumn("text", text)
        shown = F.when(hidden & is_text, redact_secret(F.col("text"))).when(hidden, "<redacted>").when(is_text, sanitize(F.col("text")))
        more = ~hidden & F.col("kind").isin("OBJECT", "ARRAY") & ~empty
        # what is shown anew is not written a second time
        level = materialise(level.select(
            "k", "path", F.when(~hidden & ~is_text, F.col("x")).alias("x"), shown.alias("shown"), more.alias("more")), "log_level")
        done.append(level.where(~F.col("more")).select(
            "k", "path", F.when(F.col("shown").isNull(), F.col("x")).otherwise(F.to_variant_object(F.array("shown"))).alias("x"), F.col("shown").isNotNull().alias("text")))
        open_ = level.where("more").select("k", "path", F.col("x").alias("v"))
        depth += 1
        if open_.isEmpty():
            break
    leaves = reduce(DataFrame.union, done)
    value = F.when(F.col("text"), F.variant_get("x", "$[0]", "variant")).otherwise(F.col("x"))
    return leaves.select(F.col("k").alias(key), "path", value.alias("value"))


def body_reference(body: Column) -> Column:
    """Length and hash of a body."""
    return F.concat(
        F.lit("<len="), F.octet_length(body).cast("string"), F.lit(" sha256="), F.sha2(body, 256), F.lit(">")
    )


def level_number(level: Column) -> Column:
    n = None
    for i, name in enumerate(LEVELS):
        n = F.when(level == name, i) if n is None else n.when(level == name, i)
    return n


def level_filter(logs: DataFrame, minimum: str, level: str = "level") -> DataFrame:
    return logs.filter(level_number(F.col(level)) >= LEVELS.index(minimum))
