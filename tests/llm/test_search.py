"""Ranked search against every document scored for every item, and the K2-treap."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from brute import prose

from maskwork.llm import k2_treap, ranked_search
from maskwork.llm.k2_treap import K2Treap
from maskwork.llm.ranked_search import build_index, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=20):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    big_n, big_l = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        rows = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * big_n) // big_l
            score = sum(k * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], "item_id bigint, text string, mark string, rank int, score int")


def found(spark, make, docs, items, **kw):
    return sorted(map(tuple, search(build_index(make(docs).repartition(3)), benchmark(spark, items), **kw).collect()), key=repr)


ITEMS = [(i, prose(500 + i, 15)) for i in range(12)]


def test_equals_brute_force(spark, make, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)  # several blocks of items
    docs = [(i, prose(i, 5 + i % 90)) for i in range(400)]
    assert found(spark, make, docs, ITEMS) == brute(docs, ITEMS)
    assert found(spark, make, docs, ITEMS, top=3) == brute(docs, ITEMS, 3)


def test_ties_repeats_and_odd_rows(spark, make, edge_rows):
    docs = [(i % 50, "same words here") for i in range(100)] + edge_rows + [(None, "same words here"), (60, "ÉCOLE École école x_y 3a"), (61, "other")]
    items = [(1, "Same WORDS"), (1, "Same WORDS"), (2, None), (3, ""), (4, "  ,;"), (5, "absentterm"), (None, "here"), (6, "école X y 3A École"),
             (7, prose(2, 80)), (8, prose(1, 60_000)), (9, "one one one")]
    assert found(spark, make, docs, items) == brute(docs, items)
    assert found(spark, make, [], items) == [] and found(spark, make, docs, []) == []
    assert found(spark, make, [(1, None), (2, "!")], items) == []


def test_shards_are_bounded_and_hold_every_posting(spark, make):
    docs = [(i, prose(i, 40)) for i in range(300)] + [(999, None), (998, "--")]
    index = build_index(make(docs).coalesce(1))
    shards = index.shards.collect()
    assert index.documents == 300 and index.terms == sum(len(terms_of(t)) for _, t in docs)
    total = sum(len(set(terms_of(t))) for _, t in docs)
    assert sum(sum(s["dfs"]) for s in shards) == total
    assert sum(len(K2Treap.from_bytes(s["treap"])._levels[1][-1]) for s in shards) == total


@pytest.mark.parametrize("seed", range(4))
def test_treap_finds_the_top_columns(seed, monkeypatch):
    monkeypatch.setattr(k2_treap, "SPREAD", 4)
    monkeypatch.setattr(k2_treap, "BATCH", 2)
    rng = np.random.default_rng(seed)
    n_rows, n_cols = [(7, 300), (300, 7), (64, 64), (1, 1)][seed]
    grid = np.where(rng.random((n_rows, n_cols)) < 0.3, rng.integers(0, 30, (n_rows, n_cols)), -1)
    grid[0, 0] = 5
    rows, cols = np.nonzero(grid >= 0)
    treap = K2Treap.from_bytes(K2Treap.build(rows, cols, grid[rows, cols]).to_bytes())
    for k in (1, 5, 1000):
        asked = rng.choice(n_rows, min(n_rows, 5), replace=False)
        weights = rng.integers(1, 2**28, len(asked))
        sums = (np.maximum(grid[asked], 0) * weights[:, None]).sum(axis=0)
        order = [c for c in np.lexsort((np.arange(n_cols), -sums))[:k] if sums[c] > 0]
        got = treap.top(asked, weights, k)
        assert got[0].tolist() == order and got[1].tolist() == sums[order].tolist()


def test_descent_leaves_most_of_the_grid_closed(monkeypatch):
    """With a few outstanding columns, most ranges are never opened to their leaves."""
    rng = np.random.default_rng(9)
    rows, cols = np.nonzero(rng.random((200, 4096)) < 0.02)
    weights = rng.integers(1, 10, len(rows))
    rows, cols = np.append(rows, np.repeat(np.arange(200), 2)), np.append(cols, np.tile([4097, 5000], 200))
    weights = np.append(weights, np.full(400, 1000))
    treap, seen = K2Treap.build(rows, cols, weights), []
    inner = K2Treap._open
    monkeypatch.setattr(K2Treap, "_open", lambda self, level, ranges, *a: seen.append(len(ranges)) or inner(self, level, ranges, *a))
    assert treap.top(np.arange(20), np.ones(20, np.int64), 2)[0].tolist() == [4097, 5000]
    assert sum(seen) < 1500
