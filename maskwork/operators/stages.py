"""Extension points: custom stages on DataFrames and the scan as a SQL view."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from maskwork.functions.patterns import BUILTIN, PASSWORDS
from maskwork.operators.detect import findings, findings_sql, matches_sql


@dataclass(frozen=True)
class Stage:
    """A DataFrame transformation with the columns it needs and the columns it adds."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Apply stages in order. A column may be produced only once and must exist when required."""
    for stage in stages:
        missing = set(stage.requires) - set(df.columns)
        if missing:
            raise ValueError(f"stage {stage.name} needs columns {sorted(missing)}")
        taken = set(stage.produces) & set(df.columns)
        if taken:
            raise ValueError(f"stage {stage.name} would overwrite columns {sorted(taken)}")
        df = df.transform(stage.apply)
        absent = set(stage.produces) - set(df.columns)
        if absent:
            raise ValueError(f"stage {stage.name} did not add columns {sorted(absent)}")
    return df


def create_scan_view(
    docs: DataFrame, key: str, text: str, name: str, kinds: Iterable[str] | None = None
) -> None:
    """Make the findings of a table available to SQL under ``name``."""
    findings(docs, [key], text, kinds=kinds).createOrReplaceTempView(name)


def scan_totals_by_kind(
    spark: SparkSession, docs: DataFrame, key: str, text: str, name: str, kinds: Iterable[str] | None = None
) -> DataFrame:
    """Totals per kind, asked in SQL over the scan view."""
    create_scan_view(docs, key, text, name, kinds)
    return spark.sql(f"SELECT kind, count(*) AS n, count(DISTINCT {key}) AS docs FROM {name} GROUP BY kind")


def register_scan_function(spark: SparkSession, name: str = "scan_findings") -> None:
    """Make the scan a SQL table function: ``SELECT d.id, f.* FROM docs d, LATERAL scan_findings(d.text) f``.

    It gives one row per finding of all built-in kinds (seq, kind, ord, start, end, text) of any text column, and none for a
    NULL. The function is SQL over built-in functions, so a query that uses it is scanned without a join or Python.
    """
    matches, words = [f"m__.m{i}" for i in range(len(BUILTIN))], [f"m__.w{i}" for i in range(len(PASSWORDS))]
    fields = [f"'{n.split('.')[1]}', {matches_sql('t', p)}" for n, p in zip(matches + words, BUILTIN + PASSWORDS)]
    array = f"transform(array(named_struct({', '.join(fields)})), m__ -> {findings_sql('t', matches, words)})[0]"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) "
        "RETURNS TABLE(seq INT, kind STRING, ord INT, start INT, end INT, text STRING) "
        f"RETURN SELECT pos, f.kind, f.ord, f.start, f.end, f.text FROM posexplode(case when t is not null then {array} end) AS (pos, f)")
