"""Actions per finding and the redactions they lead to."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.kinds import choose, default_action, tier
from maskwork.functions.masking import one_way_replacement
from maskwork.functions.patterns import BUILTIN, Pattern
from maskwork.functions.text import bound
from maskwork.operators.detect import findings
from maskwork.operators.ranking import join_null_safe
from maskwork.operators.vault import build_vault

# Kinds of the first-tier redaction in the order of its passes.
TIER1_KINDS = ("ssn", "credit_card", "email")
MAX_PART_BYTES = 512 * 1024


def resolve_action(kind: Column, by_kind: dict[str, str], default: str = "redact") -> Column:
    """Action of a kind: its own rule, else the default."""
    known = {k: v for k, v in by_kind.items() if v and v != "unknown"}
    fallback = F.lit(default or "redact")
    return choose(kind, known, fallback) if known else fallback


def resolve_action_layered(found: DataFrame, prefs: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``action``: preference, else rule, else the tier default of the kind.

    ``prefs`` and ``rules`` are (kind, action) tables. They are configuration, one row per kind, and become
    part of the expression, so findings are not shuffled on their few kinds. A table with more than
    ``MAX_POLICY_ROWS`` rows, or with two actions for one kind, is an error.
    """
    pref = {k: a for k, a in policy_of(prefs).items() if a}
    rule = {k: a for k, a in policy_of(rules).items() if a not in ("", "unknown")}
    action = default_action(F.col("kind"))
    for known in (rule, pref):
        action = choose(F.col("kind"), known, action) if known else action
    return found.withColumn("action", action)


MAX_POLICY_ROWS = 1000


def policy_of(table: DataFrame) -> dict[str, str]:
    """A (kind, action) table as a dict, checked to be small and free of contradictions."""
    rows = table.select("kind", "action").where("kind is not null").distinct().limit(MAX_POLICY_ROWS + 1).collect()
    known = {r["kind"]: r["action"] or "" for r in rows}
    if len(rows) > MAX_POLICY_ROWS:
        raise ValueError(f"a policy table has more than {MAX_POLICY_ROWS} rows")
    if len(known) < len(rows):
        raise ValueError("a policy table has two actions for one kind")
    return known


def apply_optout(found: DataFrame, flag: str = "opted_out") -> DataFrame:
    """Findings of high tier are skipped for opted-out sessions."""
    skip = F.coalesce(F.col(flag), F.lit(False)) & (tier(F.col("kind")) == "high")
    return found.withColumn("action", F.when(skip, F.lit("skip")).otherwise(F.col("action")))


def block_requests(found: DataFrame, request: str, order: Sequence[str]) -> DataFrame:
    """Requests with a blocking finding and the kind of the first one."""
    first = F.min_by("kind", F.struct(*[F.col(o) for o in order]))
    return found.filter(F.col("action") == "block").groupBy(request).agg(first.alias("block_kind"))


def split_findings(found: DataFrame, request: str) -> DataFrame:
    """Findings and warnings per request, as counts per kind."""
    counted = found.groupBy(request, "kind", "action").agg(F.count("*").alias("n"))
    warn = F.col("action") == "warn"
    pair = F.concat_ws("=", "kind", "n")
    hit = F.col("action").isin("redact", "block")

    def listed(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(cond, pair))), ",")

    return counted.groupBy(request).agg(
        listed(hit).alias("findings"),
        listed(warn).alias("warnings"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_findings"),
        F.coalesce(F.sum(F.when(warn, F.col("n"))), F.lit(0)).alias("n_warnings"),
    )


# --- first-tier redaction -----------------------------------------------------------------

_SEG = "struct<kind:string,text:string>"


def _segment(text: Column, pattern: Pattern) -> Column:
    """Cut a literal into literal and matched segments; matches that fail validation stay literal."""
    hits = F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0))
    pieces = F.split(text, pattern.java, -1)

    def matched(h: Column) -> Column:
        kind = F.lit(pattern.kind)
        if pattern.validate is not None:
            kind = F.when(pattern.validate(h), kind)
        return F.struct(kind.alias("kind"), h.alias("text"))

    literal = F.lit(None).cast("string")
    pairs = F.zip_with(
        pieces, hits,
        lambda p, h: F.array(F.struct(literal.alias("kind"), p.alias("text")), matched(h)),
    )
    cut = F.filter(F.flatten(pairs), lambda s: s["text"].isNotNull())
    whole = F.array(F.struct(literal.alias("kind"), text.alias("text")))
    ready = F.rlike(text, F.lit(pattern.java)) if pattern.gate is None else pattern.gate(text)
    return F.when(ready, cut).otherwise(whole).cast(f"array<{_SEG}>")


def tier1_segments(text: Column, kinds: Sequence[str]) -> Column:
    """Text as segments after one pass per kind, each pass over what earlier passes left.

    A pseudonym starts and ends with a bracket and holds nothing a later pass can match, so
    searching the pieces around it equals searching the text it was put into.
    """
    by_kind = {p.kind: p for p in BUILTIN}
    active = [by_kind[k] for k in TIER1_KINDS if k in kinds]
    if not active:
        return F.array(F.struct(F.lit(None).cast("string").alias("kind"), text.alias("text"))).cast(f"array<{_SEG}>")
    segs = _segment(text, active[0])
    for p in active[1:]:
        segs = F.flatten(
            F.transform(segs, lambda s: F.when(s["kind"].isNull(), _segment(s["text"], p)).otherwise(F.array(s)))
        )
    return segs


def may_match(text: Column, kinds: Sequence[str]) -> Column:
    """Whether any of the patterns occurs at all, before validation."""
    found = F.lit(False)
    for p in BUILTIN:
        if p.kind in kinds:
            hit = F.rlike(text, F.lit(p.java))
            found = found | (hit if p.gate is None else p.gate(text) & hit)
    return F.coalesce(found, F.lit(False))


def tier1_findings(
    parts: DataFrame,
    keys: Sequence[str],
    text: str,
    by_kind: dict[str, str],
    default: str = "redact",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Findings of the first-tier pass: keys, pass_no, pos, kind, text, action.

    Kinds whose action is allow are not searched at all.
    """
    actions = {k: by_kind.get(k) or default for k in TIER1_KINDS}
    active = [k for k in TIER1_KINDS if actions[k] != "allow"]
    cols = list(dict.fromkeys([*keys, *carry]))
    segs = parts.select(*cols, tier1_segments(F.col(text), active).alias("__segs"))
    rows = segs.select(*cols, F.posexplode_outer("__segs").alias("pos", "s")).filter(F.col("s.kind").isNotNull())
    passes = {k: str(i) for i, k in enumerate(TIER1_KINDS)}
    return rows.select(
        *cols,
        choose(F.col("s.kind"), passes, None).cast("int").alias("pass_no"),
        "pos", "s.kind", "s.text",
        choose(F.col("s.kind"), actions, None).alias("action"),
    )


def redact_tier1(
    parts: DataFrame,
    keys: Sequence[str],
    session: str,
    text: str,
    order: Sequence[str],
    by_kind: dict[str, str],
    default: str = "redact",
    salt: str = "salt",
    one_way: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First-tier redaction: (redacted parts, findings, vault).

    redact and warn put a pseudonym in place; block leaves the text (the request is rejected
    as a whole); redact_one_way passes through unchanged unless ``one_way`` is set.  Parts
    without findings never leave their task.  The findings are persisted; unpersist them when done.
    """
    active = [k for k in TIER1_KINDS if (by_kind.get(k) or default) != "allow"]
    suspect = may_match(F.col(text), active)
    held = parts.filter(suspect)
    # Vault, swaps and the returned table all read the findings; the texts are searched once.
    found = tier1_findings(held, keys, text, by_kind, default, carry=[session, *order]).persist()
    tokenized = found.filter(F.col("action").isin("redact", "warn"))
    vault = build_vault(tokenized, session, [*order, "pass_no", "pos"], salt)
    named = join_null_safe(
        tokenized, vault.select(session, F.col("plaintext").alias("text"), "pseudonym"), [session, "text"]
    ).select(*keys, "text", F.col("pseudonym").alias("__new"))
    if one_way:
        masked = found.filter(F.col("action") == "redact_one_way").select(
            *keys, "text", one_way_replacement(F.col("kind"), F.col("text")).alias("__new")
        )
        named = named.unionByName(masked)
    # One name per value and part, so that parts whose keys repeat do not clash.
    named = named.groupBy(*keys, "text").agg(F.min("__new").alias("__new"))
    swaps = named.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("text", "__new"))).alias("__swap"))
    hidden = [k for k in active if (by_kind.get(k) or default) in ("redact", "warn")]

    def fate(s: Column) -> Column:
        # A value that should have a name and has none is masked: nothing passes for want of a row.
        masked = F.when(s["kind"].isin(*hidden), one_way_replacement(s["kind"], s["text"])) if hidden else F.lit(None)
        swap = F.when(s["kind"].isNotNull(), F.try_element_at(F.col("__swap"), s["text"]))
        return F.coalesce(swap, masked, s["text"])

    rebuilt = F.array_join(F.transform(tier1_segments(F.col(text), active), fate), "")
    redacted = join_null_safe(held, swaps, list(keys), "left").withColumn(text, rebuilt).drop("__swap")
    return parts.filter(~suspect).unionByName(redacted), found, vault


# --- replacement pairs --------------------------------------------------------------------

BUCKET_PAIRS = 8
_META = r"([\\.\[\]{}()*+?^$|/-])"


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, _META, r"\\$1")


def _pattern_of(entries: Column) -> Column:
    """The listed texts as a pattern of two levels: the first character, then the second one, then the rest in order of the list.

    Texts that begin alike stay in their order, and that is how Java picks among alternatives; a position is compared with
    the first characters and then with the few texts that go on like it. A text of one character stands behind the
    longer ones of its group; those listed after it can never be picked and are left out.
    """
    single = F.filter(entries, lambda e: F.length(e["old"]) == 1)
    kept = F.filter(entries, lambda e: ~F.exists(single, lambda o: (o["pos"] < e["pos"]) & F.startswith(e["old"], o["old"])))
    keyed = F.array_sort(F.transform(kept, lambda e: F.struct(
        F.substring(e["old"], 1, 1).alias("c1"), (F.length(e["old"]) == 1).alias("last"), F.substring(e["old"], 2, 1).alias("c2"),
        e["pos"].alias("pos"), e["old"].alias("old"))))

    def spelled(listed: Column) -> Column:
        def piece(e: Column, i: Column) -> Column:
            before = F.get(listed, i - 1)
            rest = _quoted(F.substr(e["old"], F.lit(3)))
            second = F.concat(_quoted(e["c2"]), F.lit("(?:"), rest)
            first = F.concat(_quoted(e["c1"]), F.lit("(?:"), second)
            alike = before["c1"] == e["c1"]
            return F.when(i == 0, first).when(alike & (before["c2"] == e["c2"]), F.concat(F.lit("|"), rest)).when(
                alike, F.concat(F.lit(")|"), second)).otherwise(F.concat(F.lit("))|"), first))

        return F.concat(F.lit("(?:"), F.array_join(F.transform(listed, piece), ""), F.lit(")))"))

    return bound(keyed, spelled)


def replace_pairs(text: Column, old: Column, new: Column) -> Column:
    """One left-to-right pass; where several texts start, the earliest listed pair wins, of equal texts the first.

    ``old`` and ``new`` are arrays of equal length. Many pairs are searched by their first characters and looked up in
    buckets by hash, so the time grows with the text and its hits and hardly with the number of pairs.
    """
    listed = F.filter(
        F.zip_with(F.transform(old, lambda o, i: F.struct(o.alias("old"), i.alias("pos"))), new,
                   lambda o, n: F.struct(o["old"].alias("old"), n.alias("new"), o["pos"].alias("pos"))),
        lambda e: (F.array_position(old, e["old"]) == e["pos"] + 1) & (e["old"] != ""))
    bucket = lambda value, n: F.pmod(F.hash(value), n)

    def swapped(s: Column) -> Column:
        def named(hit: Column) -> Column:
            held = F.filter(F.get(s["buckets"], bucket(hit, F.size(s["buckets"]))), lambda e: e["old"] == hit)
            return F.get(held, F.lit(0))["new"]

        hits = F.transform(F.regexp_extract_all(s["text"], s["pattern"], F.lit(0)), named)
        pieces = F.split(s["text"], s["pattern"], -1)
        return F.array_join(F.zip_with(pieces, hits, lambda piece, name: F.concat(piece, F.coalesce(name, F.lit("")))), "")

    def searched(entries: Column) -> Column:
        n = F.greatest(F.lit(1), F.floor(F.size(entries) / BUCKET_PAIRS).cast("int"))
        buckets = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(entries, lambda e: bucket(e["old"], n) == b))
        return bound(F.struct(text.alias("text"), _pattern_of(entries).alias("pattern"), buckets.alias("buckets")), swapped)

    replaced = bound(listed, lambda entries: F.when(F.size(entries) > 0, searched(entries)).otherwise(text))
    return F.when(F.coalesce(F.size(old), F.lit(0)) > 0, replaced).otherwise(text)


def redact_one_way(scanned: DataFrame, text: str, kinds: Sequence[str] | None = None, array: str = "findings") -> DataFrame:
    """Markers and partial masks in place of the findings; nothing is stored.

    By default the kinds whose default action is redact_one_way.
    """

    def wanted(f: Column) -> Column:
        return default_action(f["kind"]) == "redact_one_way" if kinds is None else f["kind"].isin(*kinds)

    hit = F.filter(array, wanted)
    old = F.transform(hit, lambda f: f["text"])
    new = F.transform(hit, lambda f: one_way_replacement(f["kind"], f["text"]))
    return scanned.withColumn(text, replace_pairs(F.col(text), old, new))


def turn_stats(found: DataFrame, request: str) -> DataFrame:
    """Counters per request over the findings given (kind, action, seq).

    Findings are counted per kind first, so no list is longer than the list of kinds.
    """
    a = F.col("action")
    per_kind = found.groupBy(request, "kind").agg(
        F.count("*").alias("n"),
        F.count_if(a == "redact_one_way").alias("one_way"),
        F.count_if(a.isin("redact", "warn")).alias("tokenized"),
        F.count_if(a == "skip").alias("skipped"),
        F.count_if(a == "block").alias("blocked"),
        F.min(F.when(a == "redact_one_way", F.col("seq"))).alias("first_one_way"),
        F.min(F.when(a == "block", F.col("seq"))).alias("first_block"),
    )
    allowed = F.col("n") - F.col("one_way") - F.col("tokenized") - F.col("skipped") - F.col("blocked")
    return per_kind.groupBy(request).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("kinds"),
        F.sum("one_way").alias("n_one_way"),
        F.sum("tokenized").alias("n_tokenized"),
        F.sum(allowed).alias("n_allowed"),
        F.sum("skipped").alias("n_skipped"),
        F.min_by("kind", "first_one_way").alias("notify_kind"),
        F.min_by("kind", "first_block").alias("block_kind"),
    )


def with_turn_stats(requests: DataFrame, stats: DataFrame, request: str) -> DataFrame:
    """Requests with their counters; those without findings get zeros and empty strings."""
    zero = F.lit(0).cast("bigint")
    counts = ("n_one_way", "n_tokenized", "n_allowed", "n_skipped")
    names = ("kinds", "notify_kind", "block_kind")
    filled = {**{c: F.coalesce(c, zero) for c in counts}, **{c: F.coalesce(c, F.lit("")) for c in names}}
    return requests.join(stats, request, "left").withColumns(filled)


def redaction_stats(found: DataFrame, last_turn: DataFrame, request: str, msg: str) -> DataFrame:
    """Counters per request over the last user message only.

    ``found`` has kind, action and seq for all user messages; ``last_turn`` has one row
    (request, msg) per request.
    """
    scoped = found.join(last_turn.select(request, msg), [request, msg], "left_semi")
    return with_turn_stats(last_turn.select(request), turn_stats(scoped, request), request)


def size_guard(text: Column, max_bytes: int = MAX_PART_BYTES) -> Column:
    """Whether a part is too large after redaction."""
    return F.octet_length(text) > max_bytes


def find_leaks(before: DataFrame, after: DataFrame, keys: Sequence[str], text: str, kinds: Sequence[str]) -> DataFrame:
    """Values of the kinds found before that still occur after. Must be empty."""
    found = findings(before, keys, text, kinds=kinds)
    values = found.groupBy(*keys).agg(F.collect_set(F.struct("kind", F.col("text").alias("value"))).alias("__values"))
    # The values of a part travel as one list to its text, which is copied for none of them.
    beside = join_null_safe(after.select(*keys, F.col(text).alias("__after")), values, list(keys))
    left = F.filter("__values", lambda v: F.contains(F.col("__after"), v["value"]))
    return beside.select(*keys, F.explode(left).alias("__left")).select(*keys, "__left.kind", "__left.value")
