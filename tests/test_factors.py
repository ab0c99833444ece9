"""Singular values, starts and non-negative factors against numpy."""

import numpy as np
import pytest

from scholar_spark.operators import factors, themes


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    x = rng.random((40, 4)) @ rng.random((4, 25)) + rng.random((40, 25)) * 0.3
    return np.where(rng.random(x.shape) < 0.5, x, 0.0)


def cells(spark, x):
    return spark.createDataFrame([(int(i), f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id int, term string, tf double")


def matrix(df, key):
    return np.array([r[1] for r in sorted(df.collect(), key=lambda r: r[key])])


def split_start(x, k):
    """The start by its definition, from numpy's whole SVD."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((x.shape[0], k)), np.zeros((k, x.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * abs(u[:, 0]), np.sqrt(s[0]) * abs(v[0])
    for j in range(1, k):
        parts = [(np.maximum(sign * u[:, j], 0), np.maximum(sign * v[j], 0)) for sign in (1, -1)]
        a, b = max(parts, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        both = np.linalg.norm(a) * np.linalg.norm(b)
        w[:, j], h[j] = np.sqrt(s[j] * both) * a / np.linalg.norm(a), np.sqrt(s[j] * both) * b / np.linalg.norm(b)
    return np.where(w < 1e-6, x.mean(), w), np.where(h < 1e-6, x.mean(), h)


def test_singular_values_and_vectors_equal_numpys(spark, table):
    u, s, v = factors.truncated_svd(factors.Cells(cells(spark, table)), 3, wider=12, rounds=5)
    whole = np.linalg.svd(table, full_matrices=False)
    assert s == pytest.approx(whole[1][:3], rel=1e-4)
    assert abs(np.sum(matrix(u.df, "id") * whole[0][:, :3], axis=0)) == pytest.approx(1, rel=1e-4)
    assert abs(np.sum(matrix(v.df, "term") * whole[2][:3].T, axis=0)) == pytest.approx(1, rel=1e-3)


def test_start_equals_its_definition_and_is_the_same_on_every_run(spark, table):
    made = factors.Cells(cells(spark, table))
    w, h = factors.svd_start(made, 3)
    again = factors.svd_start(made, 3)
    expected = split_start(table, 3)
    assert matrix(w.df, "id") == pytest.approx(expected[0], abs=2e-2) and matrix(h.df, "term").T == pytest.approx(expected[1], abs=2e-2)
    assert matrix(again[0].df, "id") == pytest.approx(matrix(w.df, "id"), abs=1e-9)


def test_rounds_equal_multiplicative_updates_from_the_same_start(spark, table):
    made = factors.Cells(cells(spark, table))
    start = factors.svd_start(made, 3)
    w, h = matrix(start[0].df, "id"), matrix(start[1].df, "term").T
    expected = []
    for _ in range(5):
        w = w * (table @ h.T) / (w @ (h @ h.T) + 1e-12)
        h = h * (w.T @ table) / ((w.T @ w) @ h + 1e-12)
        expected.append(((table - w @ h) ** 2).sum())
    got_w, got_h, losses = factors.fit_nmf(made.x, 3, 5, tolerance=0)
    assert losses == pytest.approx(expected, rel=1e-7) and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    assert matrix(got_w, "id") == pytest.approx(w, rel=1e-5, abs=1e-9) and matrix(got_h, "term").T == pytest.approx(h, rel=1e-5, abs=1e-9)


def test_low_rank_and_empty_tables(spark):
    ones = spark.createDataFrame([(i, t, 2.0) for i in range(4) for t in "ab"], "id int, term string, tf double")
    w, h, losses = factors.fit_nmf(ones, 3, 20)
    assert w.count() == 4 and h.count() == 2 and losses[-1] < 0.1
    assert len(factors.fit_nmf(ones, 3, 4, tolerance=0, start="random")[2]) == 4
    w, h, losses = factors.fit_nmf(ones.where("id < 0"), 2)
    assert w.count() == h.count() == 0 and losses == [0.0]


def test_heaviest_terms(spark):
    h = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 3.0]), ("c", [2.0, 1.0])], "term string, h array<double>")
    got = sorted(tuple(r) for r in themes.nmf_terms(h, 2).collect())
    assert got == [(1, 0, "b"), (1, 1, "c"), (2, 0, "b"), (2, 1, "c")]
