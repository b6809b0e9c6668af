"""Masks and previews of found values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwork.functions.kinds import static_marker
from maskwork.functions.text import byte_slice


def mask_last_digits(raw: Column, n: int = 6) -> Column:
    """Star the last n digits and keep everything else."""
    return F.regexp_replace(raw, rf"[0-9](?=(?:[^0-9]*[0-9]){{0,{n - 1}}}[^0-9]*\z)", "*")


def one_way_replacement(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin("credit_card", "ssn"), mask_last_digits(raw)).otherwise(static_marker(kind))


def mask_preview(raw: Column) -> Column:
    """First and last three bytes with stars between; short values are all stars."""
    n = F.octet_length(raw)
    ends = F.concat(
        byte_slice(raw, F.lit(0), F.lit(3)), F.repeat(F.lit("*"), n - 6), byte_slice(raw, n - 3, n)
    )
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(ends)


def mask_key_cli(key: Column) -> Column:
    n = F.octet_length(key)
    return F.when(n <= 10, "sk-gw-***").otherwise(
        F.concat(F.substring(key, 1, 8), F.repeat(F.lit("*"), n - 12), F.right(key, F.lit(4)))
    )


def mask_key_desktop(key: Column) -> Column:
    return F.when(F.octet_length(key) <= 10, "").otherwise(
        F.concat(F.substring(key, 1, 8), F.lit("*" * 8), F.right(key, F.lit(4)))
    )


def mask_key_dashboard(key: Column) -> Column:
    k = F.trim(key)
    n = F.octet_length(k)
    return (
        F.when(n == 0, "")
        .when(n <= 4, F.repeat(F.lit("•"), n))
        .otherwise(F.concat(F.lit("•" * 8), F.right(k, F.lit(4))))
    )
