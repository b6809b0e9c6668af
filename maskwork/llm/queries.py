"""The registered queries of the operators: each reads its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwork.session import prepare, shared_dir


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.html_text import extract

    return extract(_table(spark, folder, "pages"))


def op2_fertility(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as public

    from maskwork.llm.fertility import quality_rules

    return quality_rules(_table(spark, folder, "documents"), public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model"),
                         public.PATTERN)


def op3_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.resampling import resample

    return resample(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.decontaminate import leaks

    return leaks(spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.substring_dedup import remove_repeats

    return remove_repeats(spark, _table(spark, folder, "documents")).drop("kept")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.secrets import digest, findings_in, scan_to_ledger

    documents = _table(spark, folder, "documents")
    ledger = scan_to_ledger(documents, shared_dir(spark, "ledger"))
    return digest(findings_in(ledger, documents, "doc_id"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.toxicity import toxicity

    return toxicity(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as public

    from maskwork.llm.token_counts import token_counts

    return token_counts(_table(spark, folder, "documents"), public.path("piece_bpe_32k.model"))


def op9_near_join(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.near_join import near_classes

    return near_classes(_table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from maskwork.llm.packing import pack

    return pack(spark, _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_subspace_join(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.subspace_join import near_vectors

    return near_vectors(_table(spark, folder, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.fim import digest, fill_in_middle

    return digest(fill_in_middle(_table(spark, folder, "documents")))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from maskwork.llm.ranked_search import build_index, search

    return search(build_index(_table(spark, folder, "documents")), _table(spark, folder, "benchmark"))


def registered() -> tuple[dict, dict[str, str]]:
    """Queries and, where SQL can express them on whole tables, their SQL."""
    from maskwork.llm import fim, ranked_search, secrets, subspace_join

    queries = {fn.__name__: fn for fn in (
        op1_html_text, op2_fertility, op3_resampling, op4_decontaminate, op5_substring_dedup, op6_secrets, op7_toxicity,
        op8_token_counts, op9_near_join, op10_packing, op11_subspace_join, op12_fill_in_middle, op13_ranked_search)}
    return queries, {
        "op6_secrets": secrets.oracle_sql(), "op11_subspace_join": subspace_join.oracle_sql(), "op12_fill_in_middle": fim.oracle_sql(),
        "op13_ranked_search": ranked_search.oracle_sql()}
