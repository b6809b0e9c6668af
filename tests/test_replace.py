"""Replacement of many listed texts in one pass."""

import random
import time

from pyspark.sql import functions as F

from maskwork.operators.redact import replace_pairs


def by_hand(text, pairs):
    out, at = [], 0
    while at < len(text):
        hit = next(((o, n) for o, n in pairs if o and text.startswith(o, at)), None)
        out.append(hit[1] if hit else text[at])
        at += len(hit[0]) if hit else 1
    return "".join(out)


def replaced(spark, rows):
    df = spark.createDataFrame([(i, t, [o for o, _ in p] if p is not None else None, [n for _, n in p] if p is not None else None) for i, (t, p) in enumerate(rows)],
                               "i int, text string, old array<string>, new array<string>")
    return {r.i: r.out for r in df.select("i", replace_pairs(F.col("text"), F.col("old"), F.col("new")).alias("out")).collect()}


def test_equals_the_list_order(spark):
    rng = random.Random(1)
    rows = [("a.b a+b $x \\ (y) é\U0001f600-", [("a.b", "1"), ("$x", "$1"), ("\\", "<bs>"), ("(y)", "[]"), ("\U0001f600", "!"), ("é", "")]),
            ("abcabcab", [("ab", "X"), ("abc", "Y")]), ("abcabcab", [("abc", "Y"), ("ab", "X"), ("a", "Z")]), ("abcabc", [("a", "Z"), ("abc", "Y"), ("bc", "W")]),
            ("aaa", [("a", "1"), ("a", "2")]), ("text", []), ("text", None), ("", [("a", "b")]), ("x", [("", "y"), ("x", "z")]), ("a|b]c[d^-/", [("|", "1"), ("]c[", "2"), ("^-/", "3")])]
    for _ in range(150):
        pairs = [("".join(rng.choice("abé\U0001f600.") for _ in range(rng.randrange(1, 5))), str(k)) for k in range(rng.randrange(1, 12))]
        rows.append(("".join(rng.choice("abé\U0001f600.") for _ in range(60)), pairs))
    got = replaced(spark, rows)
    assert got == {i: by_hand(t, p) if p else t for i, (t, p) in enumerate(rows)}


def test_many_pairs_in_a_long_text(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12)), f"[K_{k}_x]") for k in range(5000)]
    pairs += [(o[:7], f"[S_{k}_y]") for k, (o, _) in enumerate(pairs[:500])]  # prefixes of texts that are listed earlier
    parts = []
    while sum(map(len, parts)) < 1_000_000:
        parts += ["lorem ipsum dolor sit amet consectetur " * 2, rng.choice(pairs)[0], " "]
    start = time.perf_counter()
    got = replaced(spark, [("".join(parts), pairs)])[0]
    assert time.perf_counter() - start < 60
    names = dict(pairs)
    assert got == "".join(names.get(p, p) for p in parts)
