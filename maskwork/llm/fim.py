"""Fill-in-the-middle transformation of documents, cut through a learned rank index.

A document is cut at two drawn units into prefix, middle and suffix, and written with sentinels so that
the middle comes last. The draws are hashes of the document's id, so they are the same in every run. The
index (``rank_index``) covers every unit boundary of every text; the two cuts are looked up in it and
nothing is decoded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.llm.rank_index import RankIndex

SENTINELS = ("<P>", "<S>", "<M>")
CHANGED, SUFFIX_FIRST = 90, 20  # of 100
CHUNK = 4_000_000  # bytes of text that are indexed at once; a longer text is alone


def _draws(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"__h{i + 1}") for i in range(4)]


def _buffers(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a column of strings without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def _groups(bounds: np.ndarray, limit: int = CHUNK):
    """Ranges of texts of about ``limit`` bytes."""
    start = 0
    while start < len(bounds) - 1:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1)
        yield start, stop
        start = stop


def fill_in_middle(documents: DataFrame, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS, seed: int = 1,
                   changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``documents``: doc_id, n (units), form, prefix_units, middle_units, output.

    ``unit`` is ``char`` (code points), ``word`` (with the white space after it) or ``line``. ``form`` is plain
    (text unchanged, no cuts) for empty and null texts, texts that hold a sentinel and ``100 - changed`` of 100
    documents; of the others ``suffix_first`` of 100 are spm, the rest psm. Rows that repeat an id get the draws of that
    id; a null id draws as an empty one. Other columns of the input are ignored; an empty table gives no rows.
    """
    marks = [s.encode() for s in sentinels]

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            data, bounds = _buffers(texts)
            draws = [batch.column(f"__h{i}").to_numpy() for i in range(1, 5)]
            for a, b in _groups(bounds):
                part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                index = RankIndex(part, own, unit)
                n = np.diff(index.first)
                x, y = draws[0][a:b] % (n + 1), draws[1][a:b] % (n + 1)
                low, high = np.minimum(x, y), np.maximum(x, y)
                # a cut at the text's end is the text's end, not the start of the next one's first unit
                ends = own[1:]
                cut1 = np.minimum(index.offsets(index.first[:-1] + low), ends)
                cut2 = np.minimum(index.offsets(index.first[:-1] + high), ends)
                forms, outputs, raw = [], [], part.tobytes()
                for d, (start, one, two, end) in enumerate(zip(own.tolist(), cut1.tolist(), cut2.tolist(), ends.tolist())):
                    text = raw[start:end]
                    if not text or draws[2][a + d] % 100 >= changed or any(m in text for m in marks):
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = raw[start:one], raw[one:two], raw[two:end]
                    p, s, m = marks
                    first = draws[3][a + d] % 100 < suffix_first
                    forms.append("spm" if first else "psm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle) if first else (p, prefix, s, suffix, m, middle)))
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(forms, pa.string()),
                     pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                              *_draws(F.col("doc_id"), seed))
    return narrow.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was cut: its pieces hold no sentinel, so the output splits into them."""
    pieces = F.split(output, "|".join(re.escape(s) for s in sentinels))
    whole = lambda *order: F.concat(*[F.get(pieces, F.lit(i)) for i in order])
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)


def digest(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``fill_in_middle`` with hashes in place of the text."""
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form"), sentinels), 256).alias("restored_sha256"))


def oracle_sql(table: str = "documents") -> str:
    """The digest in DuckDB's SQL, cut with its own substrings."""
    return f"""
with texts as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from {table}),
drawn as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as y,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90
      then 'plain' when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from texts),
cut as (
  select *, substr(t, 1, least(x, y)) as p, substr(t, least(x, y) + 1, abs(x - y)) as m, substr(t, greatest(x, y) + 1) as s from drawn)
select doc_id, n, form, case when form <> 'plain' then least(x, y) end as prefix_chars,
  case when form <> 'plain' then abs(x - y) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end)
    as output_sha256,
  sha256(t) as restored_sha256
from cut"""
