"""Whitening against a plain eigendecomposition of the covariance, with awkward rows and degenerate tables."""

import collections
import math

import numpy as np

from draftlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, x string, place int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "c", None, 0) for i, v in rows], SCHEMA)


def _plain(rows, most):
    """{(vec_id, component): (deviation, whitened up to sign)} and the explained shares, by numpy's eigh."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    away = np.array([[float(n * c - s) for c, s in zip(r, sums)] for r in x])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    values, vectors = np.linalg.eigh((away / n).T @ (away / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    return n, deviation, away / n @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def _check(spark, vectors, usable, most=32):
    got = whitening.whiten(vectors, most).toPandas()
    n, deviation, plain, explained = _plain(usable, most)
    k = plain.shape[1]
    assert len(got) == n * k and set(got.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-8
    assert collections.Counter(zip(got[got.component == 1].vec_id.astype(float).fillna(-1), got[got.component == 1].deviation)) == collections.Counter((-1.0 if i is None else float(i), d) for (i, _), d in zip(usable, deviation))
    for c in range(k):
        own = got[got.component == c + 1]
        assert np.abs(own.explained - explained[c]).max() <= 1e-9 * explained[c] + 1e-15
        known = {i: plain[row, c] for row, (i, _) in enumerate(usable) if i is not None}
        rows = own[own.vec_id.notna()]
        want = np.array([known[int(i)] for i in rows.vec_id])
        sign = np.sign(want @ rows.whitened.to_numpy())
        assert np.abs(rows.whitened.to_numpy() - sign * want).max() < 1e-6


def test_whitening_equals_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(6, 6))
    good = [(i, [float(c) for c in rng.normal(size=6) * [9, 5, 3, 2, 1, 1] @ basis]) for i in range(300)]
    good += [(300 + i, good[0][1]) for i in range(150)] + [(None, good[1][1]), (5, good[5][1])]     # a third are copies, a null and a repeated key
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] + [1.0] * 5), (903, [float("inf")] + [1.0] * 5), (904, []), (905, [1.0])]
    _check(spark, _vectors(spark, good + bad), good)
    _check(spark, _vectors(spark, good + bad), good, most=2)


def test_fewer_deviations_than_entries(spark):
    rng = np.random.default_rng(4)
    flat = [(i, [float(a), 2.0 * float(a), 5.0, 0.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-4, 5, (80, 2)))]
    _check(spark, _vectors(spark, flat), flat)


def test_tables_without_any_component(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        assert whitening.whiten(_vectors(spark, rows)).collect() == []


def test_repeated_singular_values_keep_all_components(spark):
    cross = [(2 * i + s, [float(8 * (1 - 2 * s) * (j == i)) for j in range(5)]) for i in range(5) for s in range(2)]
    got = whitening.whiten(_vectors(spark, cross)).toPandas()
    assert len(got) == 50 and got.identity_error.max() < 1e-9 and np.allclose(got.explained, 0.2)
