"""Structured logs: JSON lines with ts, level, msg and any other fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = ("ts", "level", "msg")


def read_logs_from(lines: DataFrame, line: str) -> DataFrame:
    """ts, level, msg, fields (the other fields as strings) and error, one row per line.

    ``error`` is NULL for a JSON object and says otherwise what the line is; such a line has no fields
    and its text as ``msg``.
    """
    body = F.trim(F.coalesce(F.col(line), F.lit("")))
    fields = F.when(body.startswith("{"), F.from_json(F.col(line), "map<string,string>"))
    problem = F.when(body == "", "empty line").when(F.col("__f").isNull(), "not a JSON object")
    parsed = lines.withColumn("__f", fields).withColumn("error", problem)
    parsed = parsed.withColumn("__f", F.coalesce(F.col("__f"), F.create_map(F.lit("msg"), F.col(line))))
    return parsed.select(
        F.try_to_timestamp(F.element_at("__f", F.lit("ts"))).alias("ts"),
        F.element_at("__f", F.lit("level")).alias("level"),
        F.element_at("__f", F.lit("msg")).alias("msg"),
        F.map_filter("__f", lambda k, v: ~k.isin(*RESERVED)).alias("fields"),
        "error",
    )


def typed_logs_from(lines: DataFrame, line: str) -> DataFrame:
    """ts, level, msg, fields (the whole object as a VARIANT, so numbers, booleans and nesting keep their type), raw, error.

    Works on a batch and on a stream of lines alike. ``error`` is NULL for a JSON object; another line has no fields, its text as
    ``raw`` and says what it is. An object with a repeated name is no valid record.
    """
    text = F.col(line)
    body = F.trim(F.coalesce(text, F.lit("")))
    parsed = lines.select(text.alias("__line"), body.alias("__body"), F.when(body.startswith("{"), F.try_parse_json(body)).alias("fields"))
    problem = F.when(F.col("__body") == "", "empty line").when(F.col("fields").isNull(), "not a JSON object")
    return parsed.select(
        F.try_to_timestamp(F.try_variant_get("fields", "$.ts", "string")).alias("ts"),
        F.try_variant_get("fields", "$.level", "string").alias("level"),
        F.try_variant_get("fields", "$.msg", "string").alias("msg"),
        "fields", F.when(problem.isNotNull(), F.col("__line")).alias("raw"), problem.alias("error"))


def read_typed_logs(spark: SparkSession, path: str) -> DataFrame:
    return typed_logs_from(spark.read.text(path), "value")


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of ``read_typed_logs``: files of lines as they arrive in a folder, bad lines kept."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return typed_logs_from(reader.text(path), "value")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return read_logs_from(spark.read.text(path), "value")
