"""Ranked lexical search: K2-treaps over shards of the term-document grid.

``build_index`` cuts the documents, where they lie, into shards of bounded size. A shard is a grid of its terms
by its documents that holds each posting's impact, stored as one compressed K2-treap beside the shard's ids,
terms and document frequencies; every term of every document is in it. ``search`` takes the items in blocks of
bounded size, lets each item's term rows descend every shard's tree best first over ranges of documents, and
ranks the shards' best documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwork.llm.k2_treap import K2Treap
from maskwork.llm.words import Powers, Words, chunks, mix
from maskwork.session import materialise, shared_dir

TOP = 20
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 19
BLOCK_TERMS = 50_000  # (item, term) pairs that are sent to the tasks at once
CHUNK = 500_000
ROW_GROUP_BYTES = 16 << 20


def term_table() -> np.ndarray:
    """Values of code points for terms: ASCII letters (either case) and digits and all beyond ASCII; 0 separates."""
    table = mix(np.arange(1, 0x10001, dtype=np.uint64)) | np.uint64(1)
    code = np.arange(0x80)
    upper = (code >= 0x41) & (code <= 0x5A)
    table[:0x80][upper] = table[0x61 : 0x61 + 26]
    table[:0x80][~(upper | (code >= 0x61) & (code <= 0x7A) | (code >= 0x30) & (code <= 0x39))] = 0
    return table


class Counts:
    """Distinct terms of each text: ``owner`` (place of the text), ``term`` (hash) and ``tf``; ``lengths`` counts all terms of a text."""

    def __init__(self, texts: list, table: np.ndarray, powers: Powers) -> None:
        words = Words(texts, table, powers)
        names, place = np.unique(words.hashes, return_inverse=True)
        keys, self.tf = np.unique(words.owner * max(len(names), 1) + place, return_counts=True)
        self.owner, self.term = keys // max(len(names), 1), names[keys % max(len(names), 1)] if len(names) else names
        self.lengths = np.diff(words.bounds)


class Index(NamedTuple):
    """``shards``: docs, lengths, terms, dfs, treap, one row per shard. ``documents`` with a term, and all their ``terms``."""

    shards: DataFrame
    documents: int
    terms: int


def _totals(documents: DataFrame) -> tuple[int, int]:
    """Documents that hold a term, and the number of all terms."""

    def run(batches):
        is_term = np.ones(256, bool)
        is_term[:0x80] = term_table()[:0x80] != 0
        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            _, offsets, data = column.buffers()
            bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            docs = terms = 0
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                inside = is_term[raw[low:high]]  # a term's bytes beyond ASCII are all 0x80 and more
                n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(inside) and inside[0])
                docs, terms = docs + (n > 0), terms + n
            yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])

    texts = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.mapInArrow(run, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return total[0] or 0, total[1] or 0


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The part of a posting's score that no item changes."""
    m = 100 - 25 + (25 * lengths * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def build_index(documents: DataFrame) -> Index:
    """An index of all rows of ``documents`` that hold a term, written to the shared folder.

    Null and empty texts are in no shard. Rows that repeat an id are documents of their own, null ids come last among
    equal scores. Only ``doc_id`` and ``text`` are read; an empty table gives an index without shards.
    """
    docs_total, terms_total = _totals(documents)

    def shard(held: list) -> pa.RecordBatch:
        ids = pa.chunked_array([h[0] for h in held]).combine_chunks()
        lengths = np.concatenate([h[1] for h in held])
        begins = np.cumsum([0, *[len(h[1]) for h in held]])
        owner = np.concatenate([h[2] + b for h, b in zip(held, begins)])
        term, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        # columns in the order of the ids, so that equal scores are taken in that order
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        names, row = np.unique(term, return_inverse=True)
        treap = K2Treap.build(row, column[owner], impacts(tf, lengths[owner], docs_total, terms_total))
        lists = (ids.take(pa.array(order)), pa.array(lengths[order].astype(np.int64)), pa.array(names.view(np.int64)),
                 pa.array(np.bincount(row, minlength=len(names)).astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [*[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], pa.array([treap.to_bytes()], pa.binary())],
            ["docs", "lengths", "terms", "dfs", "treap"])

    def run(batches):
        table, powers = term_table(), Powers()
        held, docs, postings = [], 0, 0
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in chunks(texts, CHUNK):
                for start in range(a, b, SHARD_DOCS):
                    counts = Counts(texts[start : min(b, start + SHARD_DOCS)], table, powers)
                    some = np.flatnonzero(counts.lengths)
                    if not len(some):
                        continue
                    place = np.cumsum(counts.lengths > 0) - 1
                    if held and (docs + len(some) > SHARD_DOCS or postings + len(counts.tf) > SHARD_POSTINGS):
                        yield shard(held)
                        held, docs, postings = [], 0, 0
                    held.append((ids.take(pa.array(some + start)), counts.lengths[some], place[counts.owner], counts.term, counts.tf))
                    docs, postings = docs + len(some), postings + len(counts.tf)
        if held:
            yield shard(held)

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    shards = narrow.mapInArrow(
        run, "docs array<bigint>, lengths array<bigint>, terms array<bigint>, dfs array<bigint>, treap binary")
    path = shared_dir(documents.sparkSession, "treaps")
    # a shard is a row of megabytes, so a writer's buffer is kept to a few of them
    shards.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return Index(documents.sparkSession.read.schema(shards.schema).parquet(path), docs_total, terms_total)


def _mark(text: Column) -> Column:
    """Names a text; items with the same text are searched once."""
    return F.sha2(text, 256)


def _item_terms(items: DataFrame) -> DataFrame:
    """mark, term, times: the terms of each distinct text."""

    def run(batches):
        table, powers = term_table(), Powers()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK):
                counts = Counts(texts[a:b], table, powers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("mark").take(pa.array(counts.owner + a)), pa.array(counts.term.view(np.int64)), pa.array(counts.tf)],
                    ["mark", "term", "times"])

    texts = items.select(F.col("text").cast("string").alias("text")).where("text is not null").select(_mark(F.col("text")).alias("mark"), "text")
    return texts.groupBy("mark").agg(F.any_value("text").alias("text")).mapInArrow(run, "mark string, term bigint, times bigint")


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of every item, scores above 0.

    Equal scores go by ascending doc_id, null ids last. Items without a term, or whose terms no document holds, have no rows.
    Rows that repeat an item have the same result each. Items are taken in blocks of about ``BLOCK_TERMS`` terms, one pass over
    the index per block, so what is sent to the tasks is bounded by that and by one item's own text.
    """
    shards, n = index.shards, index.documents
    spark = items.sparkSession
    terms = materialise(_item_terms(items), "item_terms")
    held = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighted = terms.join(df, "term").select("mark", "term", (F.col("times") * weight).alias("weight")).where("weight > 0")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    weighted = materialise(weighted.withColumn("block", F.pmod(F.xxhash64("mark"), F.lit(blocks)).cast("int")), "item_weights")

    found = None
    for block in range(blocks):
        rows = weighted.where(F.col("block") == block).toPandas()
        sent = spark.sparkContext.broadcast([
            (mark, own["term"].to_numpy().view(np.uint64), own["weight"].to_numpy()) for mark, own in rows.groupby("mark")])
        part = shards.select("docs", "terms", "treap").mapInArrow(_searcher(sent, top), "mark string, doc_id bigint, score bigint")
        found = part if found is None else found.union(part)
    best = Window.partitionBy("mark").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    named = items.select("item_id", _mark(F.col("text").cast("string")).alias("mark"))
    return named.join(ranked, "mark").select("item_id", "rank", "doc_id", "score")


def _searcher(sent, top: int):
    def run(batches):
        items = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("docs")[i].values
                names = batch.column("terms")[i].values.to_numpy().view(np.uint64)
                treap = K2Treap.from_bytes(batch.column("treap")[i].as_py())
                marks, columns, sums = [], [], []
                for mark, terms, weights in items:
                    rows = np.searchsorted(names, terms)
                    here = rows < len(names)
                    here[here] = names[rows[here]] == terms[here]
                    cols, scores = treap.top(rows[here], weights[here], top)
                    marks += [mark] * len(cols)
                    columns.append(cols)
                    sums.append(scores)
                if marks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(marks), docs.take(pa.array(np.concatenate(columns))), pa.array(np.concatenate(sums))], ["mark", "doc_id", "score"])

    return run


def oracle_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The ranking in DuckDB's SQL, every document scored for every item."""
    terms = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    spelled = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with docs as (select row_number() over () as r, doc_id, {terms.format('text')} as ts from {documents} where text is not null),
words as (select r, {spelled} as term from (select r, unnest(ts) as t from docs)),
lengths as (select r, count(*) as n from words group by r),
totals as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from lengths),
postings as (select r, term, count(*) as tf from words group by r, term),
weights as (
  select term, cast(floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
  from postings, totals group by term, big_n),
items as (select row_number() over () as q, item_id, {terms.format('text')} as ts from {benchmark} where text is not null),
asked as (select q, term, count(*) as times from (select q, {spelled} as term from (select q, unnest(ts) as t from items)) group by q, term),
scored as (
  select q, r, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) as bigint) as score
  from asked join postings using (term) join weights using (term) join lengths using (r), totals group by q, r),
ranked as (
  select q, doc_id, score, cast(row_number() over (partition by q order by score desc, doc_id) as integer) as rank
  from scored join docs using (r) where score > 0)
select item_id, rank, doc_id, score from ranked join items using (q) where rank <= 20"""
