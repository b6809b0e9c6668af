"""Corpus scan: findings with positions and masked previews, reports and totals."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.functions.kinds import bucket, tier
from maskwork.functions.masking import mask_preview
from maskwork.functions.text import line_and_column
from maskwork.operators.detect import explode_findings, with_findings


def located_findings(docs: DataFrame, source: str, text: str) -> DataFrame:
    """One row per finding: source, kind, line, col, start, end, preview."""
    scanned = with_findings(docs.select(source, F.col(text).alias("__text")), "__text")
    # Line and column are found beside the text, so that it is not copied per finding.
    placed = scanned.withColumn(
        "findings",
        F.transform("findings", lambda f: F.struct(
            f["kind"].alias("kind"), f["ord"].alias("ord"), f["start"].alias("start"), f["end"].alias("end"),
            f["text"].alias("text"), line_and_column(F.col("__text"), f["start"]).alias("at"),
        )),
    )
    rows = placed.select(source, F.posexplode_outer("findings").alias("seq", "f")).filter(F.col("f").isNotNull())
    return rows.select(
        source, "seq", "f.kind", "f.at.line", "f.at.col", "f.start", "f.end", mask_preview(F.col("f.text")).alias("preview")
    )


def findings_report(docs: DataFrame, source: str, text: str) -> DataFrame:
    """One JSON report per document: {source, total, findings[]}. Built in the row, no shuffle."""
    scanned = with_findings(docs.select(source, F.col(text).alias("__text")), "__text")

    def item(f):
        at = line_and_column(F.col("__text"), f["start"])
        return F.struct(
            f["kind"].alias("kind"), at["line"].alias("line"), at["col"].alias("col"),
            f["start"].alias("start"), f["end"].alias("end"), f["text"].alias("text"),
        )

    report = F.struct(
        F.col(source).cast("string").alias("source"), F.size("findings").alias("total"),
        F.transform("findings", item).alias("findings"),
    )
    return scanned.select(source, F.size("findings").alias("total"), F.to_json(report).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select(F.col("report").alias("value")).write.text(path)


def corpus_report(docs: DataFrame, source: str, text: str, dims: Sequence[str] = ()) -> DataFrame:
    """Totals per kind: findings, documents, tier, bucket and the smallest masked preview."""
    kept = docs.select(source, *dims, F.col(text).alias("__text"))
    found = explode_findings(with_findings(kept, "__text"), [source, *dims])
    per_doc = found.groupBy(*dims, "kind", source).agg(
        F.count("*").alias("n"), F.min(mask_preview(F.col("text"))).alias("preview")
    )
    k = F.col("kind")
    return (
        per_doc.groupBy(*dims, "kind")
        .agg(F.sum("n").alias("findings"), F.count("*").alias("documents"), F.min("preview").alias("preview"))
        .select(*dims, "kind", tier(k).alias("tier"), bucket(k).alias("bucket"), "findings", "documents", "preview")
    )
