"""Subspace pigeonhole join against all pairs."""

import numpy as np
import pytest

from maskwork.llm.subspace_join import Space, near_vectors, rotate

KIND = "vec_id bigint, embedding array<{}>, label int, node string, links string, block int, copies string"


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of every row, sorted."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [np.array(v, float) / np.abs(np.array(v, float)).max() if g else None for (_, v), g in zip(rows, good)]
    units = [u / np.sqrt((u * u).sum()) if u is not None else None for u in units]
    n = len(rows)
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            root = find(i)
            least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    out = [(rows[i][0], links[i], least.get(find(i))) for i in range(n)]
    return sorted([(a, b, c, a == c) for a, b, c in out], key=repr)


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1, "a", "b", 2, "c") for i, v in rows], KIND.format(kind))
    return sorted(map(tuple, near_vectors(df, **kw).collect()), key=repr)


def clusters(seed, n, dims, groups, noise):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims)) + 0.3  # with a mean of its own, as real vectors have
    rows = centers[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dims))
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(n) + 5, rows)]


# noise that puts many pairs close to the threshold, on either side
@pytest.mark.parametrize("seed,dims,noise", [(1, 64, 0.2), (2, 24, 0.2), (3, 5, 0.2), (4, 100, 0.22)])
def test_equals_all_pairs(spark, seed, dims, noise):
    rows = clusters(seed, 300, dims, 25, noise)
    expected = brute(rows)
    assert sum(r[1] for r in expected) > 50
    assert run(spark, rows, cell_rows=16 * seed) == expected


def test_hot_group_is_cut_into_parts(spark):
    rows = clusters(7, 500, 32, 1, 0.1) + [(i + 1000, v) for i, v in clusters(8, 200, 32, 150, 0.2)]
    assert run(spark, rows, cell_rows=32) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]),
            (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0, 3.1]), (None, [-5.0, 1.0, 0.0]), (None, None), (10, [1e-300, 2e-300, 3e-300]),
            (11, [1e300, 2e300, 3e300]), (12, [7.0]), (13, [-7.0])]
    assert run(spark, rows, "double") == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_lone_vectors_and_other_thresholds(spark):
    rows = clusters(9, 200, 16, 10, 0.4)
    assert run(spark, rows, threshold=0.8, cell_rows=32) == brute(rows, 0.8)
    assert run(spark, rows[:1]) == [(rows[0][0], 0, rows[0][0], True)]


def test_rotation_keeps_distances_and_rows_apart():
    x = np.random.default_rng(3).normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rotate(x)
    assert np.allclose(r @ r.T, x @ x.T, atol=1e-5)
    assert np.array_equal(r[17:18], rotate(x[17:18]))


def test_every_pair_in_budget_shares_a_cell_of_some_block():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 32))
    x[200:] = x[:200] + 0.5 * rng.normal(size=(200, 32))
    x = rotate(x / np.linalg.norm(x, axis=1, keepdims=True))
    y = x.astype(float)
    space = Space.over(400, y.sum(axis=0), (y * y).sum(axis=0), 0.6, 8, 20)
    met = set()
    for b in range(len(space.blocks)):
        row, cell, home = space.cells(x, b)
        for i, c, h in zip(row.tolist(), cell.tolist(), home.tolist()):
            met |= {(min(i, j), max(i, j)) for j in row[(cell == c) & home].tolist() if not h or i != j}
    apart = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    close = {(i, j) for i, j in zip(*np.nonzero(np.triu(apart <= 0.6, 1)))}
    assert close and close <= met
    assert len(met) < 400 * 399 / 2  # cells keep some pairs apart
