"""Splines over rows against dense linear algebra."""

import numpy as np
import pytest

from framelake.operators import images as I
from framelake.operators import splines as S

KNOTS = {0: [0, 1, 2.5, 4, 6], 1: [0, 0, 1, 3, 3.5, 6, 6], 2: [-2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 8], 3: [0, 0, 0, 0, 1.5, 2, 4, 6, 6, 6, 6], 4: [float(k) for k in range(-4, 11)]}


@pytest.fixture(scope="module")
def traces(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(x), float(np.sin(x) + g + rng.normal(0, 0.2))) for g in (1, 2, 3) for x in np.concatenate((rng.uniform(-1, 7, 60), [0, 1, 6, 2.5]))]
    rows += [(3, None, 1.0), (3, 2.0, None), (4, 2.0, 5.0)]
    return rows, spark.createDataFrame(rows, "g long, x double, y double").repartition(4)


def dense(rows, g, knots, degree, outside):
    own = [(x, y) for a, x, y in rows if a == g and x is not None and y is not None]
    x, y = np.array(own).T
    return I.spline_basis(x, np.array(knots, float), degree, outside), x, y


@pytest.mark.parametrize("degree", sorted(KNOTS))
@pytest.mark.parametrize("outside", ["zero", "constant"])
def test_products_equal_the_dense_ones(traces, degree, outside):
    rows, table = traces
    knots = KNOTS[degree]
    right, square = S.products(table, "g", "x", "y", knots, degree, outside)
    right = {(r.g, r.j): r.by for r in right.collect()}
    square = {(r.g, r.j, r.k): r.bb for r in square.collect()}
    for g in (1, 2, 3, 4):
        b, _, y = dense(rows, g, knots, degree, outside)
        want, gram = b.T @ y, b.T @ b
        for j in range(b.shape[1]):
            assert abs(right.get((g, j), 0.0) - want[j]) < 1e-9
            for k in range(j, b.shape[1]):
                assert abs(square.get((g, j, k), 0.0) - gram[j, k]) < 1e-9


@pytest.mark.parametrize("smooth", [0.0, 0.7, 50.0])
@pytest.mark.parametrize("outside", ["zero", "constant"])
def test_fit_evaluation_and_slope(traces, smooth, outside):
    rows, table = traces
    knots, degree = KNOTS[3], 3
    weights = S.fit(table, "g", "x", "y", knots, degree, smooth, outside)
    found = {}
    for r in weights.collect():
        found.setdefault(r.g, {})[r.j] = r.weight
    values = {(r.g, r.x): r.value for r in S.evaluate(table, weights, "g", "x", knots, degree, outside).collect() if r.x is not None}
    turned, inner = S.slope(weights, "g", knots, degree)
    rises = {(r.g, r.x): r.value for r in S.evaluate(table, turned, "g", "x", inner, degree - 1, outside).collect() if r.x is not None}
    for g in (1, 2, 3):
        b, x, y = dense(rows, g, knots, degree, outside)
        # Smoothed least squares by one stacked system.
        rough = np.sqrt(smooth) * np.diff(np.eye(b.shape[1]), 2, axis=0)
        want = np.linalg.lstsq(np.vstack((b, rough)), np.concatenate((y, np.zeros(len(rough)))), rcond=None)[0]
        got = np.array([found[g][j] for j in range(b.shape[1])])
        assert np.allclose(got, want, atol=1e-6)
        assert all(abs(values[g, v] - f) < 1e-6 for v, f in zip(x.tolist(), b @ want))
        k, w = I.spline_slope(np.array(knots, float), want, degree)
        slopes = I.spline_basis(x, k, degree - 1, outside) @ w
        assert all(abs(rises[g, v] - f) < 1e-5 for v, f in zip(x.tolist(), slopes))
    # One value and a penalty on bends only: the weights of least size that go through it.
    assert abs(values[4, 2.0] - 5.0) < 1e-6 or smooth > 0
