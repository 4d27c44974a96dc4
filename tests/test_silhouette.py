"""Euclidean silhouettes against all pairs in numpy."""

import numpy as np
import pytest

from footfall.operators import silhouette as S

SCHEMA = "id INT, a DOUBLE, b DOUBLE, c INT, k STRING"


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = np.zeros(len(x))
    for i in range(len(x)):
        own = (k == k[i]).sum() - 1
        if own:
            a = d[i][k == k[i]].sum() / own
            b = min(d[i][k == j].mean() for j in set(k) if j != k[i])
            out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


def clouds(n, seed):
    rng = np.random.default_rng(seed)
    k = rng.integers(0, 3, n)
    x = np.column_stack([rng.normal(size=n) + 2 * (k == 1), rng.normal(size=n) * 0.5 + k, rng.integers(0, 4, n)]).astype(float)
    return x, np.array([f"k{i}" for i in k])


def frame(spark, x, k):
    rows = [(i, float(p[0]), float(p[1]), int(p[2]), str(j)) for i, (p, j) in enumerate(zip(x, k))]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def widths(df, **options):
    found = S.silhouette_euclidean(df, ["a", "b", "c"], "k", **options).collect()
    return sorted(found, key=lambda r: r["id"])


@pytest.mark.parametrize(("leaves", "block"), [(16, 50), (1, 8192), (512, 8192)])
def test_without_tolerance_equals_all_pairs(spark, leaves, block):
    x, k = clouds(700, leaves)
    x[:200], k[:200] = x[0], k[0]  # a hot group of copies
    got = widths(frame(spark, x, k), leaves=leaves, block=block)
    assert np.array([r["silhouette"] for r in got]) == pytest.approx(brute(x, k), abs=1e-9)
    assert all(r["silhouette_high"] - r["silhouette_low"] < 1e-9 for r in got) and len(got) == 700


@pytest.mark.parametrize("tolerance", [0.3, 0.05, 0.01])
def test_bounds_hold_the_true_width(spark, tolerance):
    x, k = clouds(1500, 9)
    got, true = widths(frame(spark, x, k), tolerance=tolerance, leaves=32), brute(x, k)
    low, high = (np.array([r[f"silhouette_{e}"] for r in got]) for e in ("low", "high"))
    assert (low <= true + 1e-9).all() and (true <= high + 1e-9).all() and (high - low).max() <= tolerance


def test_pairs_opened_grow_slower_than_rows(spark):
    opened = []
    for n in (1000, 4000):
        x, k = clouds(n, 5)
        opened.append(np.mean([r["opened"] for r in widths(frame(spark, x, k), tolerance=0.05, leaves=64)]))
    assert opened[1] < 2.5 * opened[0] and opened[1] < 4000 / 8


def test_lone_rows_nulls_one_cluster_and_nothing(spark):
    rows = [(0, 0.0, 0.0, 0, "p"), (1, 1.0, 0.0, 0, "p"), (2, 9.0, 0.0, 0, "alone"), (3, None, 0.0, 0, "p"), (4, 1.0, 1.0, 1, None)]
    got = widths(spark.createDataFrame(rows, SCHEMA))
    assert [r["silhouette"] for r in got][2:] == [0.0, None, None]
    assert [round(r["silhouette"], 9) for r in got[:2]] == [round(1 - 1 / 9, 9), round(1 - 1 / 8, 9)]
    assert [r["silhouette"] for r in widths(spark.createDataFrame(rows[:2], SCHEMA))] == [None, None]
    assert widths(spark.createDataFrame([], SCHEMA)) == []


def test_cell_ends_hold_the_sum():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, w = rng.normal(size=(20, 3)) * rng.uniform(0.01, 3), rng.integers(1, 5, 20).astype(float)
        cells, members = S.grown(x, w, 3)
        q = rng.normal(size=(8, 3)) * 2
        assert sorted(np.concatenate(members)) == list(range(20))
        low, high = cells.ends(q, np.zeros(8, int))
        true = np.sqrt(((q[:, None] - x) ** 2).sum(axis=2)) @ w
        assert (low <= true + 1e-9).all() and (true <= high + 1e-9).all()
        for share in (0.0, 0.1):
            a, b, _ = S.block_sums(x, w, q, share)
            assert (a <= true + 1e-9).all() and (true <= b + 1e-9).all() and ((b - a) <= share * b + 1e-9).all()
