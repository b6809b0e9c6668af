"""Secret scans over an incremental ledger of blobs, with built-in expressions only.

Every version of every text is a blob, named by the SHA-256 of its content. The ledger holds one
row per blob, rule and rule version that was ever scanned, with the spans found. A run hashes
all versions, keeps one copy of each blob, scans only the pairs of blob and rule version that the
ledger lacks, and joins the findings back to every path that has the blob. Copies of a text, however
many, are scanned once. ``scan_to_ledger`` does a run on a stored ledger, ``findings_in`` reads the result from it.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.text import bound
from maskwork.session import materialise


class Rule(NamedTuple):
    """A pattern; with ``group`` its matches count only if that group has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


def _either_case(words: str) -> str:
    """ASCII letters in both cases, spelled out because (?i) folds other letters in some engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


BASE_KINDS = ("assign", "access", "hex")

# A run of one class is maximal, so the least length of access and hex can stand in the pattern.
# That of assign cannot: a match that fails takes its text with it.
RULES = (
    Rule("assign", f"({_either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
    Rule("url", "[a-z][a-z0-9+.-]{1,30}://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@"),
)

# The pem rule finds a key by its header. To mask the key, the span runs through its END line, whatever stands
# between (no other BEGIN or END); where that line is missing, through the base64 lines that follow the header.
# All loops are possessive: a long body needs no stack and no text is read twice.
_PEM = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
_GAP = r"(?:\\{1,2}[nrt]|[\s>\"'+,|*#])"
_LINE = r"[A-Za-z0-9+/]{16,}+={0,2}+"
_PEM_END = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
_PEM_LINES = (rf"(?:{_GAP}{{1,16}}+(?:Proc-Type|DEK-Info|Comment|Subject):[^\r\n\\]*+)*+{_GAP}{{0,16}}+{_LINE}(?:{_GAP}{{1,16}}+{_LINE})*+"
              rf"(?:{_GAP}{{1,16}}+[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\x20\t\"',;]*+(?:[\r\n]|\\|\Z)))?+")
MASK_RULES = tuple(r._replace(pattern=f"{_PEM}(?:{_PEM_END}|{_PEM_LINES})?+", version=2) if r.kind == "pem" else r for r in RULES)

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, kind string, version int, spans {SPANS}"
BLOCK_HITS = 256


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each number (none below 0) and all before it.

    Totals are taken over blocks first and then inside a block, so the cost of a number does not grow with the array.
    """
    def blocks_of(all_: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_) / BLOCK_HITS).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.slice(all_, n * BLOCK_HITS + 1, F.lit(BLOCK_HITS)))

    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), join)

    def inside(block: Column, before: Column) -> Column:
        return F.transform(block, lambda _, i: join(before, total(F.slice(block, F.lit(1), i + 1))))

    def whole(blocks: Column) -> Column:
        return bound(F.transform(blocks, total), lambda totals: F.flatten(F.transform(
            blocks, lambda b, n: bound(total(F.slice(totals, F.lit(1), n)), lambda before: inside(b, before)))))

    return bound(bound(values, blocks_of), whole)


def spans_of(text: Column, rule: Rule, size: Callable[[Column], Column] = F.length) -> Column:
    """Spans of a rule's matches, end exclusive, in code points or in another ``size``.

    The gaps between matches come from a split, the matches from an extraction; both walk
    the text from left to right without overlap, so their lengths add up to the positions.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)

    def spans(h: Column) -> Column:
        ends = running(F.transform(h["hits"], lambda m: m["step"]), lambda a, b: a + b)
        each = F.zip_with(ends, h["hits"], lambda end, m: F.when(m["counts"], F.struct((end - m["size"]).alias("start"), end.alias("end"))))
        return F.array_compact(each)

    def hits(h: Column) -> Column:
        matched = F.zip_with(h["whole"], h["checked"], lambda w, part: F.struct(
            size(w).alias("size"), (F.length(part) >= rule.least).alias("counts")))
        return F.struct(F.zip_with(F.slice(h["gaps"], F.lit(1), F.size(h["whole"])), matched, lambda g, m: F.struct(
            (size(g) + m["size"]).alias("step"), m["size"].alias("size"), m["counts"].alias("counts"))).alias("hits"))

    found = bound(F.struct(whole.alias("whole"), checked.alias("checked"), gaps.alias("gaps")), lambda h: bound(hits(h), spans))
    return F.coalesce(F.when(text.rlike(rule.pattern), found), F.array().cast(SPANS))


def with_blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the content's address. A null text is the empty one."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                text: str = "text", keep: str | None = None, size: Callable[[Column], Column] = F.length) -> DataFrame:
    """(blob, found): spans by kind of each blob, from the ledger or from a scan.

    ``found`` is an array of (kind, version, scanned, spans) in the order of ``rules``; ``scanned`` tells the new
    pairs, which is what ``ledger_rows`` appends. ``keep`` names a column for the text itself.
    """
    blobs = with_blobs(versions.select(F.col(text).alias("__text")), "__text").dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("__seen", F.lit(None).cast(f"map<string,{SPANS}>"))
    else:
        known = ledger.groupBy("blob").agg(F.map_from_entries(F.collect_set(F.struct(
            F.concat_ws(":", "kind", "version"), "spans"))).alias("__seen"))  # one entry per rule version
        blobs = blobs.join(known, "blob", "left")
    body = F.coalesce(F.col("__text"), F.lit(""))
    found = []
    for rule in rules:
        old = F.try_element_at(F.col("__seen"), F.lit(f"{rule.kind}:{rule.version}"))
        found.append(F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), old.isNull().alias("scanned"),
                              F.when(old.isNotNull(), old).otherwise(spans_of(body, rule, size)).alias("spans")))
    kept = [body.alias(keep)] if keep else []
    return blobs.select("blob", *kept, F.array(*found).alias("found"))


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """(blob, kind, version, spans) of the pairs that this run scanned, to append to the ledger."""
    # outer: for an inner explode a size filter is inferred, which runs every pattern once more
    rows = scanned.select("blob", F.explode_outer("found").alias("f")).where("f.scanned")
    return rows.select("blob", "f.kind", "f.version", "f.spans")


def scan_to_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger in ``folder`` after this run: pairs of blob and rule version that it lacked are scanned and appended.

    A folder that is not there yet is an empty ledger. Should a run be repeated after a loss, rows may be there twice;
    readers take them once.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    ledger_rows(scan_unseen(versions, ledger, rules, text)).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def findings_in(ledger: DataFrame, versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """What the ledger says about each version under ``rules``: its path column, ``blob`` and ``spans``, sorted by start and kind.

    Versions whose blob the ledger does not have are left out; scan them first. Null and empty texts have no spans;
    repeated rows and copies get the same; null paths stay.
    """
    current = ledger.where(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules]))
    found = current.groupBy("blob").agg(F.collect_set(F.struct("kind", "version", "spans")).alias("found"))  # one entry per rule
    spans = flat_spans(F.col("found"), tuple(r.kind for r in rules))
    # written first; a blob that a third of the paths have then splits in the join
    known = materialise(found.select("blob", spans.alias("spans")), "known_blobs")
    narrow = with_blobs(versions.select(F.col(path), F.col(text).alias("__text")), "__text").drop("__text")
    return narrow.join(known, "blob").select(path, "blob", "spans")


def flat_spans(found: Column, kinds: tuple[str, ...]) -> Column:
    """All spans of some kinds, sorted by start, then by the kind's place in ``kinds``."""
    order = F.create_map(*[F.lit(x) for n, kind in enumerate(kinds) for x in (kind, n)])
    mine = F.filter(found, lambda f: f["kind"].isin(*kinds))
    each = F.transform(mine, lambda f: F.transform(f["spans"], lambda s: F.struct(
        s["start"].alias("start"), order[f["kind"]].alias("place"), s["end"].alias("end"), f["kind"].alias("kind"))))
    return F.array_sort(F.flatten(each))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def findings(versions: DataFrame, path: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
             text: str = "text") -> DataFrame:
    """One row per version: its path column, ``blob`` and ``spans``, sorted by start and kind.

    Null and empty texts have no spans; repeated rows and copies get the same; null paths stay.
    """
    # written like the ledger it extends; a blob that a third of the paths have then splits in the join
    scanned = materialise(scan_unseen(versions, ledger, rules, text), "scanned")
    spans = flat_spans(F.col("found"), tuple(r.kind for r in rules))
    narrow = with_blobs(versions.select(F.col(path), F.col(text).alias("__text")), "__text").drop("__text")
    return narrow.join(scanned.select("blob", spans.alias("spans")), "blob").select(path, "blob", "spans")


def digest(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select(path, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask_secrets(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span replaced by ``mark`` (spans that overlap by one) and ``n_chars`` set anew.

    Every row stays, with the columns it came with; texts without a span, null ones too, stay as they
    are. Private keys go with their bodies (``MASK_RULES``). Each blob is moved, scanned and masked once and
    joined to the other columns of its rows.
    """
    names = documents.columns
    scanned = scan_unseen(documents, rules=MASK_RULES, keep="__text", size=F.octet_length)
    spans = flat_spans(F.col("found"), tuple(r.kind for r in MASK_RULES))
    raw = F.col("__text").cast("binary")

    def cut(tops: Column) -> Column:
        def before(span: Column, i: Column) -> Column:
            done = F.coalesce(F.get(tops, i - 1), F.lit(0))
            gap = F.substring(raw, done + 1, span["start"] - done).cast("string")
            return F.when(span["start"] >= done, F.concat(gap, F.lit(mark)))

        rest = F.substring(raw, F.element_at(tops, -1) + 1, F.octet_length("__text")).cast("string")
        return F.concat(F.array_join(F.transform("__spans", before), ""), rest)

    clean = bound(running(F.transform("__spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b)), cut)
    hit = F.size("__spans") > 0
    # written first, as a blob that a third of the rows have then splits in the join
    masked = materialise(scanned.withColumn("__spans", spans).select(
        "blob", hit.alias("__hit"), F.when(hit, clean).otherwise(F.col("__text")).alias("__text")), "masked")
    narrow = with_blobs(documents).withColumn("__null", F.col("text").isNull()).drop("text")
    out = narrow.join(masked.hint("merge"), "blob")
    columns = {"text": F.when(~F.col("__null"), F.col("__text"))}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("__hit"), F.length("__text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.select(*[columns[n].alias(n) if n in columns else F.col(n) for n in names])


def oracle_sql(table: str = "documents") -> str:
    """The digest in DuckDB's SQL."""
    parts, kinds = [], ", ".join(f"'{r.kind}'" for r in RULES)
    for place, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"select n, {place} as place, '{rule.kind}' as kind, regexp_extract_all(t, '{pattern}', 0) as hits, "
            f"regexp_extract_all(t, '{pattern}', {rule.group}) as parts, string_split_regex(t, '{pattern}') as gaps, {rule.least} as least from texts")
    return f"""
with texts as (select row_number() over () as n, doc_id, coalesce(text, '') as t from {table}),
matched as ({' union all '.join(parts)}),
placed as (
  select n, place, kind, least, unnest(range(1, len(hits) + 1)) as i, hits, parts, gaps from matched),
spans as (
  select n, place, kind,
    cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) as bigint) as s,
    length(hits[i]) as size
  from placed where length(parts[i]) >= least),
named as (select n, place, kind, s, s + size as e, kind || ':' || s || ':' || (s + size) as span from spans),
summed as (
  select n, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(span, ',' order by s, place, e) filter (place < 3) as base, string_agg(span, ',' order by s, place, e) as spans
  from named group by n)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join summed using (n)"""
