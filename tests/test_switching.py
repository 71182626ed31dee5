"""Switching models over spans against the whole series, against loops, and over Spark's tasks."""

import datetime as dt
import math

import numpy as np
import pytest

from marlstone.functions import numeric, switching
from marlstone.operators import regimes


def series(n, seed=0):
    rng = np.random.default_rng(seed)
    state, out = 0, []
    for _ in range(n):
        state = state if rng.random() < 0.97 else 1 - state
        out.append(rng.standard_normal() * (0.01, 0.03)[state])
    return np.array(out)


MODEL = switching.Parameters(np.array([0.001, -0.002, 0.0]), np.array([0.01, 0.02, 0.05]), np.array([[0.9, 0.07, 0.03], [0.1, 0.85, 0.05], [0.02, 0.08, 0.9]]))


def loops(x, p):
    """(log-likelihood, filtered, smoothed, steps) day by day."""
    dens = np.exp(-0.5 * ((x[:, None] - p.means) / p.sds) ** 2) / p.sds / math.sqrt(2 * math.pi)
    now, loglik, filtered, predicted = switching.stationary(p.transition), 0.0, [], []
    for t in range(len(x)):
        predicted.append(now)
        joint = now * dens[t]
        loglik += math.log(joint.sum())
        filtered.append(joint / joint.sum())
        now = filtered[-1] @ p.transition
    smoothed, steps = [filtered[-1]], np.zeros_like(p.transition)
    for t in range(len(x) - 2, -1, -1):
        both = filtered[t][:, None] * p.transition * (smoothed[0] / predicted[t + 1])[None, :]
        steps += both
        smoothed.insert(0, both.sum(axis=1))
    return loglik, np.array(filtered), np.array(smoothed), steps


@pytest.mark.parametrize("cuts", [[], [1], [100], [30, 31, 250], list(range(7, 290, 7))])
def test_spans_add_up_to_the_series(cuts):
    x = series(300)
    loglik, filtered, smoothed, steps = loops(x, MODEL)
    parts = np.split(x, cuts)
    sums = [switching.span_sums(part, MODEL, k == 0) for k, part in enumerate(parts)]
    found, weights, found_steps = switching.expectation(sums, MODEL.transition)
    assert math.isclose(found, loglik, rel_tol=1e-12)
    assert np.allclose(found_steps, steps, atol=1e-10)
    assert np.allclose(weights, [smoothed.sum(axis=0), smoothed.T @ x, smoothed.T @ x**2], atol=1e-10)
    _, ends = switching.scan(sums, MODEL.transition)
    both = [switching.probabilities(part, MODEL, k == 0, *ends[k]) for k, part in enumerate(parts)]
    assert np.allclose(np.concatenate([f for f, _ in both]), filtered, atol=1e-10)
    assert np.allclose(np.concatenate([s for _, s in both]), smoothed, atol=1e-10)


@pytest.mark.parametrize("states", [1, 2, 3])
def test_fit_is_that_of_the_whole_series(states):
    x = series(500, 4)
    a = numeric.fit_switching(x, states, 3, 42)
    _, loglik, p = switching.fit(x, states, range(3), 42)
    assert math.isclose(a["loglik"], loglik, rel_tol=1e-9)
    assert np.allclose(a["means"], p.means, atol=1e-8) and np.allclose(a["sds"], p.sds, atol=1e-8) and np.allclose(a["transition"], p.transition, atol=1e-6)


def frame(spark, x):
    return spark.createDataFrame([(dt.date(2000, 1, 1) + dt.timedelta(days=k), float(v)) for k, v in enumerate(x)], "date date, ret double").repartition(6)


@pytest.mark.parametrize("span_rows", [10_000, 130])
def test_one_series_over_tasks(spark, span_rows):
    x = series(700, 5)
    truth = numeric.fit_switching(x, 2, 2, 42, iterations=12)
    found = regimes.fit_regime_series(frame(spark, x), 2, 2, 42, 12, span_rows).orderBy("date").collect()
    assert len(found) == 700
    assert np.allclose([r["smoothed"] for r in found], truth["smoothed"], atol=1e-6) and np.allclose([r["filtered"] for r in found], truth["filtered"], atol=1e-6)
    assert math.isclose(found[0]["loglik"], truth["loglik"], rel_tol=1e-9) and np.allclose(found[0]["means"], truth["means"], atol=1e-9)
    assert [r["state"] for r in found] == list(truth["smoothed"].argmax(axis=1))


def test_filter_over_tasks_and_odd_series(spark):
    x = series(400, 6)
    loglik, filtered, smoothed, _ = loops(x, MODEL)
    found = regimes.filter_series(frame(spark, x), MODEL.means, MODEL.sds, MODEL.transition, span_rows=90).orderBy("date").collect()
    assert np.allclose([r["filtered"] for r in found], filtered, atol=1e-9) and np.allclose([r["smoothed"] for r in found], smoothed, atol=1e-9)
    assert math.isclose(found[0]["loglik"], loglik, rel_tol=1e-10)
    none = frame(spark, [0.1]).where("false")
    assert regimes.fit_regime_series(none).collect() == [] and regimes.filter_series(none, [0.0], [1.0], [[1.0]]).collect() == []
    rows = frame(spark, [0.01]).unionByName(spark.createDataFrame([(dt.date(2001, 1, 1), None), (dt.date(2001, 1, 2), float("nan"))], "date date, ret double"))
    assert len(regimes.fit_regime_series(rows, restarts=1, iterations=3).collect()) == 1
