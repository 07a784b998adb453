"""Spectrum slicing against numpy, and whitening against its definition."""

import math

import numpy as np
import pytest

from quantloom.llm import whitening


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 7, 30):
        for _ in range(20):
            a = rng.integers(-2, 3, (d, d)).astype(float)
            a = a + a.T
            shift = float(rng.normal())
            assert whitening.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    zero_diagonal = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    assert whitening.count_above(zero_diagonal, 0.0) == 1


@pytest.mark.parametrize("values", [
    np.linspace(5, 1, 40), np.ones(20), np.array([3, 2, 2, 2, 2 - 1e-11, 1.5, 1.5 + 1e-9, *np.linspace(1, 0, 20)]),
    np.array([1e6, 1e3, 1.0, 1e-3, 1e-4]), np.array([4.0, 0.0, 0.0]), np.array([2.5])])
def test_leading(values):
    matrix = symmetric(values)
    found, vectors = whitening.leading(matrix, 16)
    want = np.sort(values)[::-1][:16]
    want = want[want > 1e-12 * values.sum()]
    assert len(found) == len(want) and np.allclose(found, want, rtol=0, atol=1e-14 * len(values) * values.max())
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * values.max()


def test_refinement_is_cubic():
    matrix = symmetric(np.linspace(2, 0.1, 12))
    spectrum = whitening.Spectrum(matrix)
    x = np.linalg.eigh(matrix)[1][:, -1] + 0.05 * np.random.default_rng(2).standard_normal(12)
    x, errors = x / np.linalg.norm(x), []
    for _ in range(3):
        value = float(x @ matrix @ x)
        errors.append(np.linalg.norm(matrix @ x - value * x))
        x = spectrum.step(value, x)
    assert errors[1] < errors[0] ** 2 and errors[2] < max(errors[1] ** 2, 1e-14)


def by_definition(rows):
    """Exact integers and numpy's eigenvectors."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v) and len(v) == 3]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(3)]
    y = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return good, n, sums, values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, (3, 1, 0.4))]) for i in range(60)]
    rows += [(100, rows[0][1])] * 40 + [(None, rows[1][1]), (7, None), (8, [1.0, None, 2.0]), (9, [1.0, float("nan"), 2.0]),
             (10, [float("inf"), 0.0, 0.0]), (11, [1.0, 2.0]), (12, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, n int")
    got = whitening.components_of(frame).collect()
    good, n, sums, values, vectors = by_definition(rows)
    assert len(got) == 3 * len(good) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-10
    for k in range(3):
        mine = {(r.vec_id, r.deviation): r for r in got if r.component == k + 1}
        sign = None
        for i, x in good:
            y = [n * a - s for a, s in zip(x, sums)]
            r = mine[i, sum(v * v for v in y)]
            want = float(np.array(y, float) / n @ vectors[:, k] / np.sqrt(values[k]))
            sign = sign or math.copysign(1, want * r.whitened)
            assert abs(r.whitened - sign * want) < 1e-9
            assert abs(r.explained - values[k] / values.sum()) < 1e-12


def test_few_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.components_of(spark.createDataFrame(rows, schema)).count() == 0
    line = [(i, [float(i), 2.0 * i]) for i in range(5)]
    assert {r.component for r in whitening.components_of(spark.createDataFrame(line, schema)).collect()} == {1}
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, -5.0])]
    got = whitening.components_of(spark.createDataFrame(huge, schema)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.deviation for r in got if r.vec_id != 3} == {None}
