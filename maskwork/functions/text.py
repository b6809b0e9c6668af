"""Column helpers on text addressed by byte offsets."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of the UTF-8 form as text; a character cut in half becomes U+FFFD."""
    raw = text.cast("binary")
    return F.make_valid_utf8(F.substring(raw, start + 1, end - start).cast("string"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


BLOCK_HITS = 256


def raw_literal(text: str) -> str:
    """A SQL string literal of just these characters."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def located_sql(text: str, matches: str, java: str, group: int) -> str:
    """SQL for array<struct<start,end,text>> with byte offsets, for matches already extracted.

    ``text`` and ``matches`` are SQL names. The text between matches comes from ``split`` with the same pattern, so the
    running sum of piece and match lengths gives each position without searching again; a group match ends where the
    whole match ends. Sums are taken in two levels, over blocks of hits and inside a block, so that many hits in one
    text cost time in proportion to their number.
    """
    pattern = raw_literal(java)
    whole = matches if group == 0 else f"regexp_extract_all({text}, {pattern}, 0)"

    def total(numbers: str) -> str:
        return f"aggregate({numbers}, 0, (t__, x__) -> t__ + x__)"

    def let(value: str, name: str, use: str) -> str:
        return f"transform(array({value}), {name} -> {use})[0]"

    def part(array: str) -> str:
        return f"slice(h__.{array}, n__ * {BLOCK_HITS} + 1, {BLOCK_HITS})"

    steps = (f"zip_with(slice(split({text}, {pattern}, -1), 1, size({whole})), {whole}, "
             "(g__, w__) -> octet_length(g__) + octet_length(w__))")
    numbers = f"sequence(0, greatest(cast(ceil(size(h__.steps) / {BLOCK_HITS}) as int) - 1, 0))"
    end = f"b__.before + {total('slice(b__.steps, 1, i__ + 1)')}"
    hit = let(end, "e__", "named_struct('start', e__ - octet_length(v__), 'end', e__, 'text', v__)")
    block = let(f"named_struct('before', {total('slice(s__, 1, n__)')}, 'steps', {part('steps')}, 'texts', {part('texts')})",
                "b__", f"transform(b__.texts, (v__, i__) -> {hit})")
    sums = f"transform({numbers}, n__ -> {total(part('steps'))})"
    return let(f"named_struct('steps', {steps}, 'texts', {matches})", "h__",
               let(sums, "s__", f"flatten(transform({numbers}, n__ -> {block}))"))


def line_and_column(text: Column, start: Column) -> Column:
    """struct<line, col> of a byte offset: 1-based line, 1-based column in characters."""
    prefix = byte_slice(text, F.lit(0), start)
    line = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
    col = F.length(F.substring_index(prefix, "\n", -1)) + 1
    return F.struct(line.alias("line"), col.alias("col"))
