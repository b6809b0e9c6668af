"""A corpus pipeline: each stage works on all documents that the stage before it kept.

``run`` writes every stage's result to the folder in ``spark.checkpoint.dir`` and reads it again,
so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwork.llm.decontaminate import drop_leaks
from maskwork.llm.near_join import keep_one_of_each
from maskwork.llm.packing import pack
from maskwork.llm.secrets import mask_secrets
from maskwork.llm.toxicity import reject_toxic
from maskwork.session import materialise, prepare


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5; toxic ones go."""
    return reject_toxic(prepare(spark), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their sequence and offset."""
    import public_tokenizers

    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_join", near_join), ("decontaminate", decontaminate), ("secrets", secrets),
          ("packing", packing)]

# The fitted scores and the tokenizer are beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
