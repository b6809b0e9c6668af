"""Reading document corpora and the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out to as many tasks as the session setting ``SPREAD`` says; without it, which is
    the rule, the file splits decide and nothing is moved.

    One small file with one row group arrives as one task; tests and bench set this for them.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), *keys) if parts else df


SPREAD = "spark.maskwork.spread.partitions"


def scan_corpus(df: DataFrame, text: str, max_bytes: int | None = None) -> DataFrame:
    """All documents, with ``oversized`` for those over ``max_bytes`` (none if no bound is given)."""
    too_long = F.octet_length(text) > max_bytes if max_bytes else F.lit(False)
    return df.withColumn("oversized", F.coalesce(too_long, F.lit(False)))


def read_text_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Whole text files as (source, text, oversized); files over ``max_bytes`` have a NULL text."""
    files = spark.read.format("binaryFile").load(path)
    too_long = F.col("length") > max_bytes if max_bytes else F.lit(False)
    return files.select(F.col("path").alias("source"), F.when(~too_long, F.decode("content", "UTF-8")).alias("text"), too_long.alias("oversized"))
