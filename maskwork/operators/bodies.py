"""Redaction inside stored request bodies.

Texts of the user messages are taken out as rows, scanned and redacted with the ordinary operators. In a
changed body only the string literals of changed texts are written anew; all other bytes stay: spelling of
numbers, order of fields, repeated fields. Bodies without anything to redact, and bodies that are not JSON,
stay byte for byte as they were; the latter are marked.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from maskwork.functions.jsonspans import spliced, user_texts
from maskwork.functions.masking import one_way_replacement
from maskwork.operators.detect import explode_findings, with_findings
from maskwork.operators.ranking import join_null_safe, sliced_rank
from maskwork.operators.vault import pseudonym


def body_texts(bodies: DataFrame, request: str, body: str) -> DataFrame:
    """request, msg_idx, is_last, blk_idx, text of every user text; blk_idx is -1 for plain-string content.

    ``is_last`` marks the newest user message, which alone counts for statistics.
    """

    def run(batches):
        for batch in _small(batches):
            texts = [user_texts(b) or [] for b in batch.column("__body").to_pylist()]
            at = pa.array([i for i, own in enumerate(texts) for _ in own], pa.int64())
            flat = [t for own in texts for t in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(request).take(at), pa.array([t.msg_idx for t in flat], pa.int32()),
                pa.array([t.is_last for t in flat], pa.bool_()), pa.array([t.blk_idx for t in flat], pa.int32()),
                pa.array([t.text for t in flat], pa.string())], [request, "msg_idx", "is_last", "blk_idx", "text"])

    narrow = bodies.select(request, F.col(body).cast("string").alias("__body"))
    key = narrow.schema[request]
    schema = StructType([key, *_schema("msg_idx int, is_last boolean, blk_idx int, text string")])
    return narrow.mapInArrow(run, schema)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, since decoded bodies take many times the memory of their Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _schema(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def body_findings(texts: DataFrame, request: str) -> DataFrame:
    """Findings of the body texts with their position in the request."""
    keys = [request, "msg_idx", "is_last", "blk_idx"]
    return explode_findings(with_findings(texts.withColumnRenamed("text", "__text"), "__text"), keys)


def body_replacements(found: DataFrame, request: str, salt: str) -> DataFrame:
    """request, msg_idx, blk_idx, old, new: replacement pairs per text in finding order.

    ``found`` carries the resolved action; skipped, allowed and blocking findings make no pair.
    """
    place = [request, "msg_idx", "blk_idx"]
    named = sliced_rank(
        found.filter(F.col("action").isin("redact", "warn")), [request], ["msg_idx", "blk_idx", "seq"],
        F.floor(F.col("msg_idx") / 1024), out="n",
    ).select(*place, "seq", F.col("text").alias("old"),
             pseudonym(F.col("kind"), F.col("n"), F.col(request), F.col("text"), salt).alias("new"))
    masked = found.filter(F.col("action") == "redact_one_way").select(
        *place, "seq", F.col("text").alias("old"), one_way_replacement(F.col("kind"), F.col("text")).alias("new")
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "old", "new")))
    return named.unionByName(masked).groupBy(*place).agg(ordered.alias("__p")).select(
        *place, F.transform("__p", lambda p: p["old"]).alias("old"), F.transform("__p", lambda p: p["new"]).alias("new")
    )


def redact_json_bodies(bodies: DataFrame, request: str, body: str, found: DataFrame, salt: str) -> DataFrame:
    """Bodies with the user texts redacted by the actions in ``found``, and ``parsed``: whether the body is JSON."""
    pairs = body_replacements(found, request, salt)
    lists = pairs.groupBy(request).agg(F.collect_set(F.struct("msg_idx", "blk_idx", "old", "new")).alias("__pairs"))
    held = join_null_safe(bodies.drop("parsed"), lists, [request], "left")

    def run(batches):
        for batch in _small(batches):
            bodies_, lists_ = batch.column(body).to_pylist(), batch.column("__pairs").to_pylist()
            out, parsed = [], []
            for text, listed in zip(bodies_, lists_):
                by_place = {(p["msg_idx"], p["blk_idx"]): list(zip(p["old"], p["new"])) for p in listed or []}
                texts = user_texts(text)
                out.append(spliced(text, texts, by_place) if by_place and texts else text)
                parsed.append(texts is not None)
            columns = [pa.array(out, pa.string()) if n == body else batch.column(n) for n in batch.schema.names if n != "__pairs"]
            names = [n for n in batch.schema.names if n != "__pairs"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parsed, pa.bool_())], [*names, "parsed"])

    kept = [f for f in held.schema.fields if f.name != "__pairs"]
    return held.mapInArrow(run, StructType([*kept, StructField("parsed", BooleanType())]))
