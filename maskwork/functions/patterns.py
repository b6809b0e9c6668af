"""Detection patterns and their translation to the regex dialect Spark runs.

The patterns are written in RE2 syntax: ``\\b`` is an ASCII word boundary and
``\\s`` has no vertical tab.  Spark runs ``java.util.regex``, where both differ,
so ``to_java`` rewrites those tokens.  A boundary next to a character that is
always a word character needs only one look-around, which is about twice as fast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwork.functions.text import raw_literal

# The detection patterns (must equal the specified detectors).
API_KEY = r"\b(?:sk|pk|api[_-]?key|token|secret)[_-][A-Za-z0-9\-]{16,64}\b"
# The editor's form of the same pattern takes any case.
API_KEY_ANY_CASE = (
    r"\b(?:[sS][kK]|[pP][kK]|[aA][pP][iI][_-]?[kK][eE][yY]|[tT][oO][kK][eE][nN]|[sS][eE][cC][rR][eE][tT])"
    r"[_-][A-Za-z0-9\-]{16,64}\b"
)
AWS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
GITHUB_TOKEN = r"\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b"
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"
CREDIT_CARD = r"\b(?:\d[ -]?){13,19}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b"
PHONE = r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]?\d{4}\b"
IP_ADDRESS = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
URL_PATH = r"""\bhttps?://[A-Za-z0-9.\-]+(?::\d+)?/[^\s"'<>)]{1,200}"""
PASSWORD_LABEL = r"(?i)\b(?:password|passwd|passcode|passphrase|pw|psd|pass)\s*[:=]\s*(\S{3,})"
PASSWORD_VERB = r"(?i)\b(?:password|passwd|passcode|passphrase)\s+(?:is|was)\s+(\S{3,})"
PSEUDONYM = r"\[[A-Z_]+_\d+_[A-Za-z0-9_\-]+\]"
INTENT_PHRASES = (
    r"\bmy (password|pw|pass|passcode|passphrase|key|api\s?key|token|secret|card|credit\s?card|cc)\b",
    r"\bhere'?s my (password|key|token|credentials?|card)\b",
    r"\b(the |this )?(password|key|token|api[_\s]?key|card|cc)\s*(is|=)\s*\S",
    r"\bcredentials?\s*:\s*",
    r"(?s)\b(login|user(name)?)\s*:[^\n]{0,200}\s*\n?\s*(password|pw|psd|pass)\s*:",
)
SECRET_IN_LOG = (
    r"sk-[A-Za-z0-9_-]{6,}|AKIA[0-9A-Z]{16}|(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}"
    r"|xox[bpars]-[A-Za-z0-9-]{10,}"
)

_WORD = "[0-9A-Za-z_]"
_EDGE = {
    "start": f"(?<!{_WORD})",  # the next character is always a word character
    "end": f"(?!{_WORD})",  # the previous character is always a word character
    "any": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
}
_SPACE = r"\t\n\f\r "


def to_java(pattern: str, edges: tuple[str, ...] = (), lead: str = "") -> str:
    """RE2 pattern -> Java pattern with the same matches.

    ``edges`` names the kind of each ``\\b`` in order ("start", "end", "any"; missing
    ones are "any").  ``lead`` is a look-ahead tried first, to leave most positions early.
    """
    out, in_class, seen, i = [], False, 0, 0
    flags = ""
    if pattern.startswith("(?i)") or pattern.startswith("(?s)"):
        flags, pattern = pattern[:4], pattern[4:]
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            i += 2
            if nxt == "b" and not in_class:
                out.append(_EDGE[edges[seen] if seen < len(edges) else "any"])
                seen += 1
            elif nxt == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{_SPACE}]")
            else:
                out.append("\\" + nxt)
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "[":
            out.append("\\")  # Java would open a nested class here
        elif ch == "]" and in_class:
            in_class = False
        elif "i" in flags and not in_class and ch in "sS":
            # RE2 folds the long s into s; Java's ASCII folding does not.
            out.append("[sSſ]")
            i += 1
            continue
        out.append(ch)
        i += 1
    return flags + lead + "".join(out)


@dataclass(frozen=True)
class Pattern:
    """One detector. ``group`` 1 means the finding is the first group, at the match's end."""

    kind: str
    regex: str
    edges: tuple[str, ...] = ()
    lead: str = ""
    group: int = 0
    gate: Gate | None = None
    validate: Callable[[Column], Column] | None = None

    @property
    def java(self) -> str:
        return to_java(self.regex, self.edges, self.lead)


class Gate:
    """A cheap check that every text with a match passes: some word in it, or a shorter pattern."""

    def __init__(self, *words: str, java: str | None = None) -> None:
        self.words, self.java = words, java

    def __call__(self, text: Column) -> Column:
        if self.java is not None:
            return F.rlike(text, F.lit(self.java))
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in self.words])

    def sql(self, text: str) -> str:
        if self.java is not None:
            return f"rlike({text}, {raw_literal(self.java)})"
        return "(" + " OR ".join(f"contains({text}, {raw_literal(w)})" for w in self.words) + ")"


def luhn_sql(raw: str) -> str:
    """The SQL of ``luhn_valid``."""
    digits = f"regexp_replace({raw}, '[^0-9]', '')"
    value = "cast(d__ as int) * if(i__ % 2 = 0, 1, 2) - if(i__ % 2 = 1 and cast(d__ as int) > 4, 9, 0)"
    total = f"aggregate(transform(split(reverse({digits}), ''), (d__, i__) -> {value}), 0, (t__, x__) -> t__ + x__)"
    return f"coalesce(case when length({digits}) between 13 and 19 then {total} % 10 = 0 end, false)"


def luhn_valid(raw: Column) -> Column:
    """13 to 19 digits after dropping everything else, with a valid mod-10 checksum."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    n = F.length(digits)
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    total = F.aggregate(values, F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.when(n.between(13, 19), total % 10 == 0), F.lit(False))


_DIGIT = r"(?=\d)"
_PASS_GATE = Gate(java="(?i)p(?:a[sſ]|w|[sſ]d)")

BUILTIN: tuple[Pattern, ...] = (
    Pattern("api_key", API_KEY, ("start", "any"), "(?=[spat])", gate=Gate(java=r"[_-][A-Za-z0-9\-]{16}")),
    Pattern("aws_key", AWS_KEY, ("start", "end"), gate=Gate("AKIA")),
    Pattern("github_token", GITHUB_TOKEN, ("start", "end"), "(?=g)",
            gate=Gate("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Pattern("private_key", PRIVATE_KEY, gate=Gate("PRIVATE KEY-----")),
    Pattern("credit_card", CREDIT_CARD, ("start", "any"), _DIGIT, validate=luhn_valid),
    Pattern("ssn", SSN, ("start", "end"), _DIGIT),
    Pattern("email", EMAIL, ("any", "end"), "(?=[A-Za-z0-9._%+\\-])", gate=Gate("@")),
    Pattern("phone", PHONE, ("end",), r"(?=[+(\d])"),
    Pattern("ip_address", IP_ADDRESS, ("start", "end"), _DIGIT),
    Pattern("url_path", URL_PATH, ("start",), "(?=h)", gate=Gate("http://", "https://")),
)

PASSWORDS: tuple[Pattern, ...] = (
    Pattern("password", PASSWORD_LABEL, ("start",), group=1, gate=_PASS_GATE),
    Pattern("password", PASSWORD_VERB, ("start",), group=1, gate=_PASS_GATE),
)

KIND_ORDER: tuple[str, ...] = tuple(p.kind for p in BUILTIN) + ("password",)


def register_pattern(
    patterns: tuple[Pattern, ...],
    kind: str,
    regex: str,
    validator: Callable[[Column], Column] | None = None,
) -> tuple[Pattern, ...]:
    """A new pattern list with one more detector (or with the one of that kind replaced)."""
    new = Pattern(kind, regex, validate=validator)
    if any(p.kind == kind for p in patterns):
        return tuple(replace(new) if p.kind == kind else p for p in patterns)
    return patterns + (new,)
