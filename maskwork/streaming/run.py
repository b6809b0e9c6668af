"""Starting streams and reading what they wrote."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.session import prepare, shared_dir


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema of the files already there.

    ``path`` is a folder of files, or one file if its name ends in .parquet and nothing lies under it.
    """
    batch = prepare(spark).read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str, progress: list | None = None) -> DataFrame:
    """Process everything available in append mode and read the written rows back.

    ``progress`` receives the query's progress reports, which tell how many rows its state holds.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_batches(stream: DataFrame, name: str, per_batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a batch operator to every micro-batch; a repeated batch overwrites its own folder."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)

    def write(df: DataFrame, batch_id: int) -> None:
        per_batch(df).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows").drop("batch")


def run_complete(totals: DataFrame, name: str) -> DataFrame:
    """Run an aggregate in complete mode; the table is what the last micro-batch made of all rows so far."""
    return _run_each(totals, name, "complete", lambda df, before: df)


def run_folded(stream: DataFrame, name: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """Carry a table over the micro-batches: ``fold(table so far or None, batch)`` is the next table.

    Each batch reads its predecessor's table and writes its own, so a repeated batch gives the same.
    """
    return _run_each(stream, name, "append", lambda df, before: fold(before, df))


def _run_each(stream: DataFrame, name: str, mode: str, make: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    done: list[int] = []

    def write(df: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(df.schema).parquet(f"{base}/rows/{batch_id - 1}") if batch_id else None
        make(df, before).write.mode("overwrite").parquet(f"{base}/rows/{batch_id}")
        done.append(batch_id)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows/{done[-1]}")


def run_updates(counts: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregate in update mode: every micro-batch writes the groups it changed, the latest row of a group
    counts. Groups still open at the end are in it too."""
    spark = counts.sparkSession
    base = shared_dir(spark, name)

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/rows/{batch_id}")

    query = (
        counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rest = [c for c in counts.columns if c not in keys]
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/rows")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__last"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"__last.{c}") for c in counts.columns])
