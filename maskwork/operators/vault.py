"""Pseudonyms: numbering, lookup tables and restoring.

A pseudonym reads ``[KIND_n_suffix]``.  The number follows the order of discovery in the
session; the suffix is a keyed hash, so a retried task makes the same one.  The salt must
be kept secret and the vault table is as sensitive as the plaintext it holds.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.patterns import PSEUDONYM
from maskwork.operators.ranking import join_null_safe, sliced_rank

SUFFIX_CHARS = 12


def pseudonym(kind: Column, n: Column, owner: Column, plaintext: Column, salt: str) -> Column:
    # concat_ws leaves a NULL owner out, which no other owner does
    seed = F.concat_ws("|", F.lit(salt), owner.cast("string"), n.cast("string"), plaintext)
    return F.concat(
        F.lit("["), F.upper(F.replace(kind, F.lit("-"), F.lit("_"))), F.lit("_"), n.cast("string"), F.lit("_"),
        F.substring(F.sha2(seed, 256), 1, SUFFIX_CHARS), F.lit("]"),
    )


def build_vault(
    found: DataFrame, session: str, order: Sequence[str], salt: str, slice_size: int = 4096
) -> DataFrame:
    """session, plaintext, kind, n, pseudonym: one row per distinct value of a session.

    The first finding decides kind and number.  ``order`` starts with an integer (a message
    number), which cuts a giant session into slices.
    """
    first = (
        found.groupBy(session, F.col("text").alias("plaintext"))
        .agg(F.min(F.struct(*[F.col(o) for o in order], F.col("kind"))).alias("first"))
        .select(session, "plaintext", "first.*")
    )
    ranked = sliced_rank(first, [session], order, F.floor(F.col(order[0]) / slice_size), out="n")
    name = pseudonym(F.col("kind"), F.col("n"), F.col(session), F.col("plaintext"), salt)
    return ranked.select(session, "plaintext", "kind", "n", name.alias("pseudonym"))


def build_local_vault(
    found: DataFrame, request: str, order: Sequence[str], salt: str, slice_size: int = 4096
) -> DataFrame:
    """Every finding of a request gets the next number, repeated values included.

    ``effective`` marks the pair that a left-to-right replacement uses for its text within
    one part: the earliest listed one.
    """
    ranked = sliced_rank(found, [request], order, F.floor(F.col(order[0]) / slice_size), out="n")
    named = ranked.withColumn("pseudonym", pseudonym(F.col("kind"), F.col("n"), F.col(request), F.col("text"), salt))
    part = [request, *order[:-1]]
    firsts = named.groupBy(*part, "text").agg(F.min("n").alias("__first"))
    return (
        join_null_safe(named, firsts, [*part, "text"])
        .withColumn("effective", F.col("n") == F.col("__first"))
        .drop("__first")
    )


def pseudonyms_in(text: Column) -> Column:
    """Bracketed tokens of the pseudonym shape, empty where there is no bracket at all."""
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all(text, F.lit(PSEUDONYM), F.lit(0))
    return F.when(F.contains(text, F.lit("[")), hits).otherwise(none)


def replace_tokens(text: Column, pattern: str, tokens: Column, lookup: Column) -> Column:
    """Put ``lookup[token]`` in place of each token found by ``pattern``; unknown ones stay."""
    pieces = F.split(text, pattern, -1)
    swapped = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(lookup, t), t))
    zipped = F.zip_with(pieces, swapped, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    return F.array_join(zipped, "")


def restore(texts: DataFrame, keys: Sequence[str], session: str, text: str, vault: DataFrame) -> DataFrame:
    """Replace the session's own pseudonyms by their plaintext; other tokens stay as they are.

    Only texts with a token take part in the join.  The lookup side is grouped back to one
    small map per text, so a text is never copied per token.
    """
    marked = texts.withColumn("__tokens", pseudonyms_in(F.col(text)))
    plain = marked.filter(F.size("__tokens") == 0).drop("__tokens")
    held = marked.filter(F.size("__tokens") > 0)
    tokens = held.select(
        *keys, F.col(session).alias("__session"), F.explode(F.array_distinct("__tokens")).alias("pseudonym")
    )
    known = vault.select(F.col(session).alias("__session"), "pseudonym", "plaintext")
    maps = (
        join_null_safe(tokens, known, ["__session", "pseudonym"])
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("pseudonym", "plaintext"))).alias("__map"))
    )
    done = (
        join_null_safe(held, maps, list(keys), "left")
        .withColumn(
            text,
            F.when(F.col("__map").isNull(), F.col(text)).otherwise(
                replace_tokens(F.col(text), PSEUDONYM, F.col("__tokens"), F.col("__map"))
            ),
        )
        .drop("__tokens", "__map")
    )
    return plain.unionByName(done)
