"""Toxicity: a factorization machine over hashed terms.

A text's terms are its normalised words and their prefixes, hashed into ``2 ** bits``
buckets and taken once each.  The score is the logistic of

    bias + sum of weights + half of ((sum of vectors) squared - sum of squared vectors)

so that pairs of terms (an insult beside the mention of a group) count beyond what both add
alone. Terms take part if they tell something alone or in a pair with another one.  The machine is fitted on at most ``fit_rows`` labelled rows, chosen by a hash of the
id; everything is scored, whole texts, in one pass over the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from maskwork.llm.words import Powers, Words, chunks, plain_table

PREFIXES = (4, 5)
FIT_ROWS = 12_000
BITS = 17
PAIR_TERMS, PAIR_ROWS = 1024, 10  # terms whose pairs are looked at before fitting, and rows a pair needs


def text_terms(texts: list, table: np.ndarray, powers: Powers, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text and their bounds."""
    words = Words(texts, table, powers)
    shift = np.uint64(64 - bits)
    owner = words.owner.astype(np.uint64) << np.uint64(bits)
    whole = owner | (words.hashes >> shift)
    parts = [owner | ((words.prefixes(n) * np.uint64(0x9E3779B97F4A7C15)) >> shift) for n in PREFIXES]
    terms = np.unique(np.concatenate([whole, *parts]))
    bounds = np.searchsorted(terms >> np.uint64(bits), np.arange(len(texts) + 1, dtype=np.uint64))
    return (terms & np.uint64((1 << bits) - 1)).astype(np.int64), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows ``bounds[d]:bounds[d + 1]``, 0 for none."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def _off(ones: np.ndarray, held: np.ndarray, mean: np.ndarray | float, least: float) -> np.ndarray:
    """Whether ``ones`` of ``held`` rows are ``least`` standard errors off the share ``mean``."""
    return np.abs(ones - held * mean) >= least * np.sqrt(np.maximum(held * mean * (1 - mean), 1e-9))


def _telling(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray, used: np.ndarray, least: float) -> np.ndarray:
    """Common terms, telling alone or not, that tell something in a pair: where both are there, the share of label 1 lies beyond
    what either has alone. Telling terms are paired with all common ones."""
    common = np.union1d(np.argsort(-held, kind="stable")[:PAIR_TERMS], np.flatnonzero(used))
    common = common[np.argsort(-held[common], kind="stable")][: 2 * PAIR_TERMS]
    common = np.sort(common[held[common] >= PAIR_ROWS])
    place = np.full(len(held), -1)
    place[common] = np.arange(len(common))
    both, ones = np.zeros((2, len(common), len(common)), np.float32)
    for at in range(0, len(rows), 1024):
        part = rows[at : at + 1024]
        grid = np.zeros((len(part), len(common)), np.float32)
        own, term = np.repeat(np.arange(len(part)), [len(r) for r in part]), place[np.concatenate(part)]
        grid[own[term >= 0], term[term >= 0]] = 1
        both += grid.T @ grid
        grid1 = grid[labels[at : at + 1024] == 1]
        ones += grid1.T @ grid1
    single = np.diag(ones) / np.maximum(np.diag(both), 1)
    # the share nearest to the pair's own that one of its terms has alone, or that lies between the two
    low, high = np.minimum(single[:, None], single[None, :]), np.maximum(single[:, None], single[None, :])
    share = np.clip(ones / np.maximum(both, 1), low, high)
    pairs = (both >= PAIR_ROWS) & _off(ones, both, np.clip(share, 1e-6, 1 - 1e-6), least)
    np.fill_diagonal(pairs, False)
    return common[pairs.any(axis=0)]


class FactorizationMachine:
    """Logistic factorization machine, fitted by AdaGrad over small batches."""

    def __init__(self, bits: int = BITS, factors: int = 4, seed: int = 7) -> None:
        self.bits, self.factors = bits, factors
        self.bias = 0.0
        self.weights = np.zeros(1 << bits, np.float32)
        self.vectors = np.zeros((1 << bits, factors), np.float32)
        self.rng = np.random.default_rng(seed)

    def margins(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        vectors = self.vectors[terms]
        pairs = _sums(vectors, bounds) ** 2 - _sums(vectors * vectors, bounds)
        return self.bias + _sums(self.weights[terms], bounds) + 0.5 * pairs.sum(axis=1)

    def scores(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(terms, bounds), -30, 30)))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, steps: int = 6000, rate: float = 0.2,
            decay: float = 1e-4, least: float = 4.0, batch: int = 64) -> FactorizationMachine:
        """Terms keep weight 0 unless they tell something, alone or in a pair (``_telling``): of the many rare terms of a
        corpus, nearly all say nothing about a new text."""
        if not len(rows) or labels.min() == labels.max():
            self.bias = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
            return self
        every, mean = np.concatenate(rows), labels.mean()
        held = np.bincount(every, minlength=len(self.weights))
        ones = np.bincount(every, np.repeat(labels, [len(r) for r in rows]), minlength=len(self.weights))
        used = _off(ones, held, mean, least) & (held >= 3)
        used[_telling(rows, labels, held, used, least + 1)] = True
        rows = [r[used[r]] for r in rows]
        epochs = max(4, -(-steps * batch // len(rows)))
        self.vectors[used] = self.rng.normal(0, 0.01, (used.sum(), self.factors))
        base = float(np.log(labels.mean() / (1 - labels.mean())))
        self.bias = base
        seen_w, seen_v = np.full(len(self.weights), 1e-2), np.full(self.vectors.shape, 1e-2)
        for _ in range(epochs):
            order = self.rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                lengths = np.array([len(rows[i]) for i in pick])
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                if not bounds[-1]:
                    continue
                terms = np.concatenate([rows[i] for i in pick])
                error = self.scores(terms, bounds) - labels[pick]
                each = np.repeat(error, lengths)
                mine = self.vectors[terms]
                around = np.repeat(_sums(mine, bounds), lengths, axis=0) - mine
                ids, where = np.unique(terms, return_inverse=True)
                grad_w = np.bincount(where, each) + decay * self.weights[ids]
                grad_v = np.stack([np.bincount(where, each * around[:, f]) for f in range(self.factors)], 1)
                grad_v += decay * self.vectors[ids]
                seen_w[ids] += grad_w**2
                seen_v[ids] += grad_v**2
                self.weights[ids] -= rate * grad_w / np.sqrt(seen_w[ids])
                self.vectors[ids] -= 0.3 * rate * grad_v / np.sqrt(seen_v[ids])
                self.bias -= 0.1 * rate * float(error.mean())
        return self


def term_rows(documents: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS) -> pa.Table:
    """draw, terms and toxic of at most ``fit_rows`` labelled documents outside the held-out fifth, those of the
    least draws (hashes of the id)."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(fit_rows)
    )
    # at most fit_rows rows of three numbers: small enough to broadcast whatever the table's size
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def terms(batches):
        table, powers = plain_table(), Powers()
        for batch in batches:
            texts, toxic, draw = batch.column("text").to_pylist(), batch.column("toxic"), batch.column("draw")
            for a, b in chunks(texts):
                found, bounds = text_terms(texts[a:b], table, powers, bits)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([draw.slice(a, b - a), lists, toxic.slice(a, b - a).cast(pa.int32())],
                                                 ["draw", "terms", "toxic"])

    # of rows that repeat an id one stays, so at most fit_rows rows reach the driver
    found = rows.mapInArrow(terms, "draw bigint, terms array<int>, toxic int").groupBy("draw").agg(
        F.min(F.struct(F.xxhash64("terms").alias("hash"), "terms", "toxic")).alias("one"))
    return found.select("draw", "one.terms", "one.toxic").toArrow()


def fit(documents: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS) -> FactorizationMachine:
    """The machine for these labels. Repeated ids take their highest label and one of their texts; no label at all gives an even score."""
    table = term_rows(documents, labels, bits, fit_rows)
    rows, label, draw = [], table.column("toxic").to_numpy().astype(np.float64), table.column("draw").to_numpy()
    for chunk in table.column("terms").chunks:
        bounds, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        rows += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    # rows come back in no fixed order; by draw, every run fits the same machine
    order = sorted(range(len(rows)), key=lambda i: (draw[i], label[i], len(rows[i])))
    return FactorizationMachine(bits).fit([rows[i] for i in order], label[order])


def score(spark: SparkSession, documents: DataFrame, machine: FactorizationMachine, text: str = "text") -> DataFrame:
    """``documents`` with ``score`` and ``predicted``. A null or empty text gets the bias alone.

    Columns of those names that the input has are replaced; all others are kept.
    """
    documents = documents.drop("score", "predicted")
    shared = spark.sparkContext.broadcast((machine.bits, machine.factors, machine.bias, machine.weights, machine.vectors))

    def run(batches):
        bits, factors, bias, weights, vectors = shared.value
        model = FactorizationMachine(1, factors)
        model.bits, model.bias, model.weights, model.vectors = bits, bias, weights, vectors
        table, powers = plain_table(), Powers()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            parts = [model.scores(*text_terms(texts[a:b], table, powers, bits)) for a, b in chunks(texts)]
            value = np.concatenate(parts) if parts else np.zeros(0)
            columns = [*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    schema = StructType([*documents.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return documents.mapInArrow(run, schema)


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null ids are scored and never held out; repeated rows are scored alike; an empty table gives no rows.
    """
    scored = score(spark, documents.select("doc_id", "text"), fit(documents, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def reject_toxic(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with the columns they came with."""
    names = documents.columns
    scored = score(spark, documents, fit(documents, labels))
    return scored.where("predicted = 0").select(*names)
