"""Fill-in-the-middle against plain string slices, and the learned rank index."""

import hashlib
import random
import re

import numpy as np
import pytest
from brute import prose

from maskwork.llm.fim import digest, fill_in_middle, restore
from maskwork.llm.rank_index import RankIndex, fit


def units_of(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])|^[\x20\x09-\x0D]+$|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)


def brute(rows, unit="char"):
    out = []
    for i, text in rows:
        text = text or ""
        u = units_of(text, unit)
        n = len(u)
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
            out.append((i, n, "plain", None, None, text))
        elif h4 % 100 < 20:
            out.append((i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(5)
    letters = "abcde \n\t" + "éßж中\U0001d4b3́<>"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(300)]
    return rows + [(1000, "x<P>y"), (1001, "<M"), (1002, "<S"), (1003, "\n\n a\r\n b"), (1004, " "), (1005, "<<P"), (-7, "negative id")]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_slices(spark, make, edge_rows, unit):
    rows = texts() + edge_rows
    got = fill_in_middle(make(rows), unit)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, unit)
    assert got.where(restore(got.output, got.form) != got.output).count() > 0


def test_digest_restores_every_text(spark, make, edge_rows):
    rows = texts() + edge_rows
    got = digest(fill_in_middle(make(rows)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(i, n, f, p, m, sha(o)) for i, n, f, p, m, o in brute(rows)]
    assert sorted([tuple(r)[:6] for r in got.collect()], key=repr) == sorted(expected, key=repr)
    assert sorted(r["restored_sha256"] for r in got.collect()) == sorted(sha(t or "") for _, t in rows)
    assert digest(fill_in_middle(make([]))).collect() == []


def test_forms_are_drawn_as_stated(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'some text' as text")
    share = {r["form"]: r["count"] / 20_000 for r in fill_in_middle(df).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.01 and abs(share["spm"] - 0.18) < 0.01


def test_other_settings(spark, make):
    rows = [(i, prose(i, 30)) for i in range(50)]
    forms = {r["form"] for r in fill_in_middle(make(rows), changed=100, suffix_first=100).collect()}
    assert forms == {"spm"}
    out = fill_in_middle(make(rows), sentinels=("[p]", "[s]", "[m]"), seed=3, changed=100).collect()
    assert all("[m]" in r["output"] for r in out)


@pytest.mark.parametrize("window", [7, 64, 1 << 20])
@pytest.mark.parametrize("seed", range(3))
def test_index_is_exact(seed, window):
    rng = random.Random(seed)
    docs = ["".join(rng.choice("ab " + "é中\U0001d4b3" * seed) for _ in range(rng.choice([0, 0, 1, 5, 700]))) for _ in range(30)]
    raw = [d.encode() for d in docs]
    bounds = np.cumsum([0, *map(len, raw)])
    index = RankIndex(np.frombuffer(b"".join(raw), np.uint8), bounds, "char", window)
    starts = [len("".join(docs).encode()[:0])] if not any(docs) else np.cumsum([0, *[len(c.encode()) for c in "".join(docs)]])
    assert index.offsets(np.arange(index.size + 1)).tolist() == list(starts)
    assert np.diff(index.first).tolist() == [len(d) for d in docs]


def test_segments_are_few_and_bounded():
    rng = np.random.default_rng(2)
    offsets = np.cumsum(rng.choice([1, 2], 200_000, p=[0.93, 0.07]))
    first, slope, residuals = fit(offsets, 100)
    assert len(first) < 200 and np.abs(residuals).max() <= 100
    jump = np.concatenate([np.arange(1000), np.arange(1000) + 10**6, 10**7 + 300 * np.arange(50) ** 2])
    first, slope, residuals = fit(jump)
    at = np.searchsorted(first, np.arange(len(jump)), side="right") - 1
    predicted = jump[first[at]] + np.rint(slope[at] * (np.arange(len(jump)) - first[at])).astype(int)
    assert np.array_equal(predicted + residuals, jump)
