"""Numeric kernels and optimisers: known answers, identities and domination."""

import math

import numpy as np
import pytest

from marlstone.functions import numeric, optimizers
from marlstone.functions.calendar import Calendar, CalendarMismatch, require_trading_days, resolve
from marlstone.operators import factors, networks
from marlstone.plans.strategies import normalised

VOLS = np.array([0.10, 0.20, 0.30])
RHO = np.array([[1, 0.3, 0.1], [0.3, 1, 0.2], [0.1, 0.2, 1]])
COV = np.outer(VOLS, VOLS) * RHO
NAMES = ("A", "B", "C")


def test_calendars():
    assert resolve([]) is resolve([Calendar.CONTINUOUS, Calendar.TRADING_DAYS]) is Calendar.TRADING_DAYS
    assert resolve([Calendar.CONTINUOUS] * 2).periods_per_year == 365 and Calendar.parse("odd") is Calendar.TRADING_DAYS
    with pytest.raises(CalendarMismatch):
        require_trading_days(Calendar.CONTINUOUS, "x")


def test_distributions():
    assert abs(numeric.normal_quantile(0.05) + 1.6448536269514729) < 1e-12
    assert abs(numeric.student_two_sided(2.0, 10) - 0.07338803477074) < 1e-9
    assert abs(numeric.student_two_sided(1.96, 1e6) - numeric.normal_two_sided(1.96)) < 1e-5


def test_pareto_recovers_its_shape():
    r = np.random.default_rng(0)
    for shape in (0.3, 0.1, -0.2):
        u = r.random(20000)
        got, scale = numeric.fit_pareto(((1 - u) ** -shape - 1) / shape * 0.02)
        assert abs(got - shape) < 0.03 and abs(scale - 0.02) < 0.001
    tail = numeric.pot_tail(r.exponential(0.01, 500), 0.02, 10000, 0.99)
    assert abs(tail["shape"]) < 0.15 and tail["cvar_evt"] > tail["var_evt"] and numeric.pot_tail(np.ones(5), 0, 100, 0.99)["reason"]


def test_linkage_tree_and_clusters():
    blocks = np.full((6, 6), 0.1)
    blocks[:3, :3] = blocks[3:, 3:] = 0.9
    np.fill_diagonal(blocks, 1)
    for method in ("ward", "single", "average", "complete"):
        c = networks.clusters(blocks, list("ABCDEF"), 2, method)
        assert len({c.labels[t] for t in "ABC"}) == len({c.labels[t] for t in "DEF"}) == 1 and c.labels["A"] != c.labels["F"]
        assert sorted(c.order) == list("ABCDEF")
    tree = networks.spanning_tree(blocks, list("ABCDEF"))
    assert len(tree.edges) == 5 and sum(tree.degree().values()) == 10 and len(tree.leaves()) >= 2
    assert len(numeric.spanning_tree(np.zeros((4, 4)))) == 3


def test_min_variance_dominates():
    free = optimizers.min_variance(COV, NAMES, optimizers.LONG_SHORT)
    inverse = np.linalg.solve(COV, np.ones(3))
    assert np.allclose(free.weights, inverse / inverse.sum())
    best = optimizers.min_variance(COV, NAMES, optimizers.Constraints(max_weight=0.6))
    assert best.success and abs(best.net - 1) < 1e-9 and best.weights.max() <= 0.6 + 1e-9
    r = np.random.default_rng(1)
    for _ in range(300):
        w = optimizers.project(r.normal(size=3), np.zeros(3), np.full(3, 0.6), 1.0)
        assert w @ COV @ w >= best.volatility**2 - 1e-10
    with pytest.raises(ValueError):
        optimizers.min_variance(COV, NAMES, optimizers.Constraints(max_weight=0.2))


def test_larger_problems_meet_the_optimality_conditions():
    r = np.random.default_rng(2)
    a = r.normal(size=(60, 12))
    cov = a.T @ a / 60
    w = optimizers.min_variance(cov, [str(i) for i in range(12)]).weights
    g = cov @ w
    inside = w > 1e-8
    assert np.ptp(g[inside]) < 1e-8 and (g[~inside] >= g[inside].mean() - 1e-8).all()


def test_frontier():
    mu = np.array([0.03, 0.06, 0.10])
    points = optimizers.efficient_frontier(COV, mu, NAMES, points=15)
    assert len(points) == 15 and all(b["volatility"] >= a["volatility"] - 1e-10 for a, b in zip(points, points[1:])) and abs(points[-1]["target"] - 0.10) < 1e-9


def test_risk_parity():
    p = optimizers.risk_parity(COV, NAMES)
    rc = optimizers.risk_contributions(p.weights, COV)
    assert p.success and np.ptp(rc) < 1e-9 and abs(rc.sum() - p.volatility) < 1e-12
    b = optimizers.risk_parity(COV, NAMES, budgets=[0.5, 0.3, 0.2])
    assert b.success and np.allclose(optimizers.risk_contributions(b.weights, COV) / b.volatility, [0.5, 0.3, 0.2], atol=1e-6)
    capped = optimizers.risk_parity(COV, NAMES, optimizers.Constraints(max_weight=0.4))
    assert capped.weights.max() <= 0.4 + 1e-9 and abs(capped.net - 1) < 1e-9


def test_hrp_is_sane_where_min_variance_is_not():
    vols = np.linspace(0.1, 0.3, 6)
    cov = np.outer(vols, vols) * np.where(np.eye(6, dtype=bool), 1, 0.999)
    names = list("ABCDEF")
    assert np.linalg.cond(cov) > 1e4 and optimizers.min_variance(cov, names, optimizers.LONG_SHORT).gross > 2
    h = optimizers.hrp(cov, names)
    assert abs(h.gross - 1) < 1e-9 and (h.weights > 0).all()
    assert optimizers.hrp(cov, names, optimizers.Constraints(max_weight=0.2)).weights.max() <= 0.2 + 1e-9


def test_regimes_are_recovered():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(5e-4, 0.005, 500), r.normal(-1.5e-3, 0.022, 250), r.normal(5e-4, 0.005, 500)])
    m = numeric.fit_switching(x, 2, 2)
    assert m["smoothed"][520:730].argmax(axis=1).mean() > 0.95 and m["smoothed"][50:450].argmax(axis=1).mean() < 0.05
    assert np.allclose(m["filtered"][-1], m["smoothed"][-1]) and np.abs(m["filtered"] - m["smoothed"]).max() > 0.1
    assert np.allclose(m["transition"].sum(axis=1), 1) and m["sds"][0] < m["sds"][1]


def test_components_and_concentration():
    r = np.random.default_rng(3)
    common = r.normal(size=1500)
    one = np.cov(np.array([common + 0.1 * r.normal(size=1500) for _ in range(5)]))
    free = np.cov(r.normal(size=(5, 1500)))
    names = list("ABCDE")
    p = factors.principal_components(one, names)
    assert p.explained[0] > 0.9 and p.n_factors_for(0.9) == 1 and (np.abs(p.loadings).max(axis=0) == p.loadings.max(axis=0)).all()
    book = dict.fromkeys(names, 0.2)
    assert factors.concentration(book, one, names)["verdict"] == "HIGH" and factors.concentration(book, free, names)["effective_bets"] > 3


def test_weights_are_checked():
    assert normalised({"A": 2, "B": 2, "C": 0}, NAMES) == {"A": 0.5, "B": 0.5}
    for bad in ({"X": 1}, {"A": math.nan}, {"A": -1}, {}):
        with pytest.raises(ValueError):
            normalised(bad, NAMES)


def test_critical_line_against_the_quadratic_solver():
    rng = np.random.default_rng(12)
    for n in (1, 2, 3, 5, 8):
        for _ in range(6):
            x = rng.standard_normal((3 * n + 3, n))
            cov, mu = x.T @ x / len(x), rng.standard_normal(n)
            low, high = np.zeros(n), np.full(n, max(1.0 / n, rng.uniform(0.3, 1.0)))
            corners = optimizers.critical_line(cov, mu, low, high)
            returns = [mu @ c.weights for c in corners]
            assert all(a >= b - 1e-9 for a, b in zip(returns[:-1], returns[1:])) and corners[-1].trade == 0
            best, ok = optimizers.quadratic(cov, low, high, 1.0)
            assert ok and corners[-1].weights @ cov @ corners[-1].weights <= best @ cov @ best + 1e-9
            for c in corners:
                assert abs(c.weights.sum() - 1) < 1e-9 and (c.weights >= low - 1e-9).all() and (c.weights <= high + 1e-9).all()
            for a, b in zip(corners[:-1], corners[1:]):
                w = (a.weights + b.weights) / 2
                other, ok = optimizers.quadratic(cov, low, high, 1.0, mu, float(mu @ w))
                assert not ok or w @ cov @ w <= other @ cov @ other + 1e-7


def test_critical_line_of_odd_inputs():
    assert len(optimizers.critical_line([[1.0]], [0.1], 0.0, 1.0)) == 2
    same = optimizers.critical_line(np.eye(3), [0.1, 0.1, 0.1], 0.0, 1.0)
    assert np.allclose(same[-1].weights, 1 / 3)
    fixed = optimizers.critical_line(np.eye(2), [0.1, 0.2], 0.5, 0.5)
    assert np.allclose(fixed[-1].weights, 0.5)
    for bad in ((0.6, 1.0), (0.0, 0.4), (-np.inf, 1.0)):
        with pytest.raises(ValueError):
            optimizers.critical_line(np.eye(2), [0.1, 0.2], *bad)
