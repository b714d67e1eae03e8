"""Noise, autoregressive models and constrained deconvolution of sources against planted truth."""

import numpy as np
import pytest
from framelake.operators import extraction as X


def planted(rng, g, n=3000, rate=0.02, noise=0.15, level=2.0):
    events = (rng.random(n) < rate) * rng.uniform(0.8, 2.0, n)
    calcium = np.convolve(events, X.response(np.array(g), n))[:n]
    return events, calcium, level + calcium + rng.normal(0, noise, n)


def test_noise_level():
    rng = np.random.default_rng(0)
    for g in ((0.9,), (1.6, -0.63)):
        assert abs(X.noise_level(planted(rng, g, noise=0.5)[2]) / 0.5 - 1) < 0.15
        # Events rise at once, so they have some power at all frequencies: a small noise reads too high, never too low.
        assert 0.05 <= X.noise_level(planted(rng, g, noise=0.05)[2]) < 0.2
    assert abs(X.noise_level(rng.normal(0, 0.3, 5000)) / 0.3 - 1) < 0.03
    assert X.noise_level(np.ones(100)) < 1e-9 and X.noise_level(np.ones(2)) == 0.0


@pytest.mark.parametrize("g", [(0.7,), (0.9,), (0.95,)])
def test_planted_decay(g):
    rng = np.random.default_rng(1)
    found = [X.coefficients(y, 1)[0] for y in (planted(rng, g, n=12000)[2] for _ in range(5))]
    assert abs(np.median(found) - g[0]) < 0.03


def test_planted_second_order():
    rng = np.random.default_rng(2)
    g = (1.6, -0.63)  # roots 0.9 and 0.7
    found = np.median([X.coefficients(y, 2) for y in (planted(rng, g, n=20000)[2] for _ in range(7))], axis=0)
    assert np.allclose(X.response(found, 40), X.response(np.array(g), 40), atol=0.25)
    # Coefficients of anything are stable.
    for y in (rng.normal(size=50), np.cumsum(rng.normal(size=200)), np.ones(30), np.arange(5.0)):
        for order in (1, 2, 3):
            g = X.coefficients(y, order)
            assert np.abs(np.roots(np.concatenate(([1.0], -g)))).max(initial=0) < 0.99


@pytest.mark.parametrize("order", [1, 2])
def test_any_order_solves_the_same_problem(order):
    rng = np.random.default_rng(3)
    g = np.array([0.85]) if order == 1 else np.array([1.5, -0.55])
    _, _, y = planted(rng, g, n=80, rate=0.1, level=0.0)
    n, penalty = len(y), 0.2
    grow = np.array([[X.response(g, n)[t - s] if t >= s else 0.0 for s in range(n)] for t in range(n)])
    s = np.zeros(n)
    rate = 1 / np.linalg.norm(grow, 2) ** 2
    for _ in range(30000):
        s = np.maximum(s - rate * (grow.T @ (grow @ s - y) + penalty), 0)
    cost = lambda e: 0.5 * ((grow @ e - y) ** 2).sum() + penalty * e.sum()
    calcium, events = X.deconvolve_any(y, g, penalty, rounds=5000)
    assert cost(events) <= cost(s) * 1.001 + 1e-4 and np.allclose(grow @ events, calcium, atol=1e-6)


def test_residual_is_the_noise():
    rng = np.random.default_rng(4)
    _, _, y = planted(rng, (0.9,), level=0.0)
    calcium, events, penalty = X.constrained(y, np.array([0.9]), 0.15)
    assert penalty > 0 and (events >= 0).all() and abs(np.sqrt(((y - calcium) ** 2).mean()) / 0.15 - 1) < 0.01
    # More penalty than that leaves more than the noise, and a trace without room has none.
    assert ((y - X.deconvolve(y, 0.9, penalty * 1.05)[0]) ** 2).mean() > 0.15**2
    assert X.constrained(y, np.array([0.9]), 1e-3)[2] == 0.0


def test_sources_have_models_of_their_own(spark):
    rng = np.random.default_rng(5)
    truth = {"a": (0.8, 0.2), "b": (0.93, 0.3), "c": (0.93, 0.15)}
    rows, events = [], {}
    for name, (decay, noise) in truth.items():
        events[name], _, y = planted(rng, (decay,), n=4000, rate=0.01, noise=noise)
        rows += [(name, k, float(v)) for k, v in enumerate(y)]
    rows.append(("a", 9999, None))
    models = X.source_models(spark.createDataFrame(rows, "roi_id string, frame long, f double").repartition(3))
    found = {r.roi_id: r for r in models.collect()}
    assert found.keys() == truth.keys() and len({round(r.penalty, 6) for r in found.values()}) == 3
    traces = X.model_traces(models).toPandas()
    for name, (decay, noise) in truth.items():
        r = found[name]
        assert abs(r.coefficients[0] - decay) < 0.06 and abs(r.noise / noise - 1) < 0.5 and abs(r.baseline - 2.0) < 0.15
        own = traces[traces.roi_id == name].sort_values("frame")["event"].to_numpy()
        assert len(own) == 4000
        smooth = lambda e: np.convolve(e, np.ones(5), "same")
        assert np.corrcoef(smooth(own), smooth(events[name]))[0, 1] > 0.85
        # Most of what is found lies at planted events.
        near = np.convolve(events[name] > 0, np.ones(5), "same") > 0
        assert own[near].sum() > 0.8 * own.sum()


def test_results_are_saved_and_read(spark, tmp_path):
    tables = {"sources": spark.range(3), "models": spark.range(2)}
    X.write_results(tables, str(tmp_path))
    back = X.read_results(spark, str(tmp_path), "models")
    assert back.keys() == {"models"} and back["models"].count() == 2


def test_a_long_trace_is_convolved_in_blocks():
    rng = np.random.default_rng(2)
    g, y = np.array([1.2, -0.4]), rng.random(20_000)
    taps = X.fading(g, len(y))
    assert taps < 1000 and abs(X.response(g, 3000)[taps:]).max() < 1e-17
    grow = X.convolution(np.fft.rfft(X.response(g, taps), 4096), taps, 4096)
    want = np.convolve(y, X.response(g, taps))[: len(y)]
    assert np.allclose(grow(y), want, atol=1e-12)
    assert X.fading(np.array([1.0, 0.0]), 50) == 50
    calcium, events = X.deconvolve_any(grow((y > 0.99) * 1.0), g, 0.0)
    assert np.allclose(events, y > 0.99, atol=1e-3) and np.allclose(calcium, grow(events), atol=1e-9)
