"""Covariance estimators, backtest settings, walk-forward, example strategies, the store's pointers, connectors, commands."""

import datetime as dt
import io
import json
import urllib.error
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import numeric, optimizers
from marlstone.operators import covariance, factors, panel, regimes, stress
from marlstone.plans import backtest, report, strategies, walkforward
from marlstone.sources import connectors, ingest, registry
from marlstone.sources.store import Store
from tests.test_library import Always, day, long_frame


def plain_constant_correlation(x):
    """The estimator written out in loops over pairs, for assets that all move."""
    t, n = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / t
    sd = np.sqrt(np.diag(s))
    mean = np.mean([s[i, j] / (sd[i] * sd[j]) for i in range(n) for j in range(n) if i != j])
    f = np.array([[s[i, i] if i == j else mean * sd[i] * sd[j] for j in range(n)] for i in range(n)])
    pi = np.array([[np.mean((x[:, i] * x[:, j] - s[i, j]) ** 2) for j in range(n)] for i in range(n)])
    rho = np.trace(pi)
    for i in range(n):
        for j in range(n):
            if i != j:
                ii = np.mean((x[:, i] ** 2 - s[i, i]) * (x[:, i] * x[:, j] - s[i, j]))
                jj = np.mean((x[:, j] ** 2 - s[j, j]) * (x[:, i] * x[:, j] - s[i, j]))
                rho += mean / 2 * (sd[j] / sd[i] * ii + sd[i] / sd[j] * jj)
    delta = min(max((pi.sum() - rho) / ((f - s) ** 2).sum() / t, 0), 1)
    return delta * f + (1 - delta) * s * t / (t - 1), delta


def test_constant_correlation_by_pairs(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 0.01, (80, 4)) @ (np.eye(4) + 0.3 * r.normal(size=(4, 4)))
    want, delta = plain_constant_correlation(x)
    got, shrink = numeric.shrunk_to_constant_correlation(*numeric.window_moments(x))
    assert np.allclose(got, want, rtol=1e-9) and abs(shrink - delta) < 1e-9 and 0 < delta < 1
    table = covariance.estimate(long_frame(spark, x), list("ABCD"), "constant_correlation")
    assert np.allclose(table.values, want, rtol=1e-8) and abs(table.shrinkage - delta) < 1e-8
    flat = np.column_stack([x, np.zeros(80)])
    got, _ = numeric.shrunk_to_constant_correlation(*numeric.window_moments(flat))
    assert np.isfinite(got).all() and (got[4] == 0).all() and (got[:, 4] == 0).all()
    assert np.allclose(numeric.shrunk_to_constant_correlation(*numeric.window_moments(x[:, :1]))[0], np.var(x[:, 0], ddof=1))


class Seen:
    name = "seen"

    def __init__(self, want):
        self.want = want

    def target_weights(self, context):
        assert np.allclose(context.covariance, self.want(context.returns) * 252)
        return dict.fromkeys(context.universe, 1.0)


@pytest.mark.parametrize("method, want", [("sample", lambda w: np.cov(w, rowvar=False)), ("constant_correlation", lambda w: plain_constant_correlation(w)[0]), ("ewma", lambda w: covariance_ewma(w)), ("ledoit_wolf", lambda w: numeric.shrunk_to_identity(*numeric.window_moments(w)[:3])[0])])
def test_contexts_have_the_configured_covariance(method, want):
    x = np.random.default_rng(1).normal(0, 0.01, (70, 3))
    backtest.run_one(Seen(want), [day(i) for i in range(70)], x, "ABC", backtest.BacktestConfig(lookback=30, covariance=method))
    assert backtest.BacktestConfig().covariance == "constant_correlation"
    with pytest.raises(ValueError):
        backtest.BacktestConfig(covariance="odd")


def covariance_ewma(w):
    weight = 0.94 ** np.arange(len(w))[::-1]
    return (w * (weight / weight.sum())[:, None]).T @ w


def test_settings_and_short_histories():
    x = np.zeros((30, 2))
    for bad in ({"rebalance": "hourly"}, {"regime_refit": "never"}, {"lookback": 1}):
        with pytest.raises(ValueError):
            backtest.BacktestConfig(**bad)
    with pytest.raises(ValueError, match="warmup"):
        backtest.run_one(strategies.EqualWeight(), [day(i) for i in range(30)], x, "AB", backtest.BacktestConfig(lookback=30))
    assert backtest.run_one(strategies.EqualWeight(), [day(i) for i in range(30)], x, "AB", backtest.BacktestConfig(lookback=29))["equity"]


class Regimes:
    name = "regimes"

    def __init__(self):
        self.seen = []

    def target_weights(self, context):
        self.seen.append(context.regime)
        return dict.fromkeys(context.universe, 1.0)


def test_regimes_come_from_a_market_only():
    r = np.random.default_rng(2)
    dates, x = [day(i) for i in range(320)], r.normal(0, 0.01, (320, 2))
    config = backtest.BacktestConfig(lookback=40, regime=True, regime_restarts=1, regime_iterations=5, min_regime_obs=250, publication_lag_days=10)
    none, some = Regimes(), Regimes()
    backtest.run_one(none, dates, x, "AB", config)
    backtest.run_one(some, dates, x, "AB", config, dates, list(x[:, 0]))
    assert set(none.seen) == {None} and some.seen[0] is None and some.seen[-1] is not None
    assert some.seen[-1].fitted_through <= dates[-1] - dt.timedelta(days=10)


class Fails:
    name = "fails"

    def target_weights(self, context):
        raise ValueError("no weights today")


def test_walk_forward_leaves_failing_candidates_out(spark):
    m = np.random.default_rng(5).normal(1e-3, 0.01, (300, 2))
    df = long_frame(spark, m)
    folds = walkforward.make_folds([day(i) for i in range(300)], 2, min_train=100)
    config = backtest.BacktestConfig(lookback=20)
    rows, selection = walkforward.walk_forward(df, [Fails(), Always("A")], folds, config)
    got = selection.orderBy("fold").collect()
    assert [r.winner for r in got] == ["only_A"] * 2 and set(got[0].scores) == {"only_A"} and got[0].test_start == folds[0].test_start
    assert walkforward.selection_metrics(selection)["selection_stability"] == 1.0
    assert rows.where("kind = 'equity'").count() == 200
    with pytest.raises(ValueError):
        walkforward.walk_forward(df, [Fails()], folds, config)
    with pytest.raises(ValueError):
        walkforward.walk_forward(df, [], folds, config)
    late = walkforward.make_folds([day(i) for i in range(300)], 2, min_train=15)  # the first fold is too short for any
    _, selection = walkforward.walk_forward(df, [Always("B")], late, config)
    assert [r.fold for r in selection.collect()] == [1]


def context(returns, regime=None, universe=("A", "B", "TLT")):
    n = len(returns)
    return strategies.Context(day(n), universe, np.asarray(returns, dtype=float), tuple(day(i) for i in range(n)), np.eye(3), {}, regime=regime)


def test_example_strategies():
    equal = dict.fromkeys(("A", "B", "TLT"), 1 / 3)
    rising = [[0.01, 0.02, 0.0]] * 30
    assert strategies.Momentum(1).target_weights(context(rising[:21])) == equal
    assert strategies.Momentum(1, skip=10).target_weights(context(rising[:20] + [[0.5, -0.5, 0.0]] * 10)) == {"B": 1.0}
    assert strategies.DeriskOnDrawdown().target_weights(context([[-0.05] * 3] * 5)) == {"TLT": 1.0}
    assert strategies.DeriskOnDrawdown("ZZ").target_weights(context([[-0.05] * 3] * 5)) == equal == strategies.DeriskOnDrawdown().target_weights(context(rising))
    stress_state = regimes.RegimeState((0.1, 0.9), ("calm", "stress"), day(2))
    assert strategies.RegimeAware().target_weights(context(rising, stress_state)) == {"TLT": 1.0}
    assert strategies.RegimeAware().target_weights(context(rising)) == equal


def test_frontiers_have_all_their_points():
    r = np.random.default_rng(0)
    for n in (2, 3, 6):
        a = r.normal(size=(n, n))
        cov, mu = a @ a.T * 1e-4, r.normal(5e-4, 3e-4, n)
        points = optimizers.efficient_frontier(cov, mu, [str(i) for i in range(n)], points=15)
        assert len(points) == 15 and all(abs(mu @ p["weights"] - p["target"]) < 1e-9 and abs(p["weights"].sum() - 1) < 1e-9 for p in points)
        w = r.dirichlet(np.ones(n), 4000)
        vols = np.sqrt(np.einsum("ij,jk,ik->i", w, cov, w))
        for p in points[1:]:
            near = vols[w @ mu >= p["target"]]
            assert not len(near) or p["volatility"] <= near.min() + 1e-9


def test_implied_covariance_by_regressions(spark):
    r = np.random.default_rng(4)
    f = r.normal(0, 0.01, (120, 2))
    y = f @ [[1.0, 0.2, -0.5], [0.3, 0.9, 0.1]] + r.normal(0, 0.004, (120, 3))
    wide = spark.createDataFrame([(day(i), float(a), float(b)) for i, (a, b) in enumerate(f)], "date date, m double, s double")
    got = factors.estimate_implied_covariance(long_frame(spark, y), wide, list("ABC"), ["m", "s"], 1)
    x = np.column_stack([np.ones(120), f])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    want = b[1:].T @ np.cov(f, rowvar=False) @ b[1:] + np.diag(((y - x @ b) ** 2).sum(axis=0) / 117)
    assert np.allclose(got, want, rtol=1e-8)


def test_factor_replay_names_empty_windows(spark):
    f = spark.createDataFrame([(day(i), "m", 0.01 * (-1) ** i) for i in range(20)], "date date, factor string, value double")
    windows = stress.scenarios(spark, [("w", str(day(2)), str(day(7))), ("none", "1990-01-01", "1990-02-01")])
    out = stress.replay_factors(f, {"m": 2.0}, windows)
    assert abs(out.head().pnl - ((1.02 * 0.98) ** 3 - 1)) < 1e-12
    assert abs(stress.replay_factor_contributions(f, {"m": 2.0}, windows).head().contribution) < 1e-12
    with pytest.raises(ValueError, match="none"):
        stress.require_windows(out, windows)


def test_upserts_do_not_depend_on_partitions(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 2), (1, "z", 1), (3, "c", 1), (3, "d", 1)], "k int, v string, at int")
    for n in (1, 3, 7):
        assert sorted(map(tuple, panel.upserted(old, new.repartition(n), ["k"], ["at"]).collect())) == [(1, "x", 2), (2, "b", 0), (3, "d", 1)]


PRICES = "date date, open double, high double, low double, close double, adj_close double, volume double"


def test_a_crash_between_the_steps_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda p: spark.createDataFrame([(day(i), p, p, p, p, p, 1.0) for i in range(5)], PRICES)
    store.write_prices("A/1", frame(1.0))
    store.write_prices("BB", frame(2.0))
    monkeypatch.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.write_prices("BB", frame(9.0))
    monkeypatch.undo()
    assert store.table("prices", ["BB"]).agg(F.max("close")).head()[0] == 2.0 and store.available_tickers() == ["A/1", "BB"]
    (tmp_path / "s" / "prices" / "pointers" / "00000003").write_text('{"BB": ')  # a writer that died within its pointer
    assert store.table("prices").count() == 10
    store.write_prices("BB", frame(3.0))
    assert store.table("prices", ["BB"]).agg(F.min("close")).head()[0] == 3.0
    before = store.table("prices")
    assert store.vacuum("prices", keep=1) == 2 and before.count() == 10 and store.table("prices").count() == 10


def test_two_writers_keep_each_others_parts(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    frame = spark.createDataFrame([(day(0), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], PRICES)
    a.write_prices("A", frame)
    seen = Store.parts
    raced = []

    def parts(self, name):
        out = seen(self, name)
        if self is a and not raced and "B" not in out:
            raced.append(1)
            b.write_prices("B", frame)  # between this writer's reading and its pointer
        return out

    monkeypatch.setattr(Store, "parts", parts)
    a._replace(frame.withColumn("ticker", F.lit("C")), "prices", "C")
    monkeypatch.undo()
    assert {"A", "C"} <= set(a.parts("prices"))
    assert a.available_tickers() == ["A", "B", "C"]


class Answer(io.BytesIO):
    pass


def test_gets_are_tried_again():
    calls = []

    def opener(request, timeout):
        calls.append(request)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None) if len(calls) == 1 else urllib.error.URLError("reset")
        return Answer(b"body")

    assert connectors.http_get("http://x/y", {"a": 1}, {"Accept": "text/csv"}, delay=0, opener=opener) == b"body"
    assert calls[0].full_url == "http://x/y?a=1" and calls[0].get_header("Accept") == "text/csv" and calls[0].get_header("User-agent")
    with pytest.raises(RuntimeError):
        connectors.http_get("http://x", delay=0, opener=lambda request, timeout: (_ for _ in ()).throw(urllib.error.HTTPError("u", 500, "", {}, None)))


def fake_get(url, params=None, headers=None, timeout=30):
    if url == connectors.FRED:
        assert params["id"] == "DGS10"
        return b"DATE,DGS10\n2024-01-02,3.95\n2024-01-03,.\n"
    if url.startswith(connectors.ECB):
        return b'KEY,TIME_PERIOD,OBS_VALUE,TITLE\nk,2024-01-02,4.0,"a, b"\n'
    if url.startswith(connectors.FRENCH):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("f.csv", "text\n\n,Mkt-RF,RF\n20240102, 1.0, 0.02\n20240103, 2.0, 0.02\n\n")
        return out.getvalue()
    if url.startswith(connectors.YAHOO):
        if "NONE" in url:
            return b'{"chart": {"result": null}}'
        return json.dumps({"chart": {"result": [{"timestamp": [1704205800, 1704292200], "meta": {"gmtoffset": -18000}, "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1, 2], "volume": [5, None]}], "adjclose": [{"adjclose": [0.5, 1.5]}]}}]}}).encode()
    start = int(params["startTime"])
    days = [start + k * 86_400_000 for k in range(2)] if start < 1704240000000 else []
    return json.dumps([[t, "1", "2", "0.5", "1.5", "9", t] for t in days]).encode()


def test_connectors_fill_a_store(spark, tmp_path):
    from marlstone.sources.spec import PortfolioSpec

    assert registry.source("prices", "BTC-USD").backend == "exchange" and registry.source("prices", "SPY").backend == "yahoo" and registry.available_crypto()[0] == "BTC-USD"
    spec = PortfolioSpec.from_dict({"name": "x", "start": "2024-01-01", "positions": [{"ticker": "SPY", "weight": 0.5}, {"ticker": "BTC-USD", "weight": 0.3, "asset_class": "crypto"}, {"ticker": "NONE", "weight": 0.2}], "rates": ["USD_10Y", "EUR_MRO"], "factor_datasets": ["FF3"], "factor_start": "2024-01-03"})
    store = Store(spark, str(tmp_path / "s"))
    results = {r.name: r for r in ingest.ingest_specification(spec, store, connectors.Connectors(spark, fake_get))}
    assert not results["NONE"].ok and sum(r.ok for r in results.values()) == 5
    spy = store.table("prices", ["SPY"]).orderBy("date").collect()
    assert [(str(r.date), r.adj_close) for r in spy] == [("2024-01-02", 0.5), ("2024-01-03", 1.5)]
    assert store.table("prices", ["BTC-USD"]).count() == 2 and store.calendar_for("BTC-USD").value == "continuous"
    assert {r.series_id: r.value for r in store.table("rates").collect()} == {"USD_10Y": 3.95, "EUR_MRO": 4.0}
    assert [(str(r.date), r.factor) for r in store.table("factors").orderBy("factor").collect()] == [("2024-01-03", "Mkt-RF"), ("2024-01-03", "RF")]


def test_tearsheets_warn(spark, tmp_path):
    df = long_frame(spark, np.random.default_rng(0).normal(1e-3, 0.01, (90, 2)))
    config = backtest.BacktestConfig(lookback=20)
    rows = backtest.run_all(df, [strategies.EqualWeight()], config)
    meta = backtest.RunMeta.create(strategies.EqualWeight(), config, "AB")
    folds = walkforward.make_folds([day(i) for i in range(90)], 2, min_train=30)
    metrics = {"selection_stability": 0.5, "fold_selection": [{"fold": 0, "winner": "a", "score": 1.0}, {"fold": 1, "winner": "b", "score": 2.0}]}
    result = backtest.BacktestResult.of(rows, "equal_weight", meta, metrics)
    assert any("in sample" in w for w in report.run_warnings(result))
    result.folds = folds
    payload = report.tearsheet(result)
    assert any("50%" in w for w in payload["meta"]["warnings"])
    found = {s["id"]: s for s in payload["sections"]}
    assert "error" not in found["walkforward"] and found["walkforward"]["tables"][0]["rows"][1][-2] == "b"


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from marlstone.plans import __main__ as command

    monkeypatch.setattr(command, "local_session", lambda *a, **k: spark)
    store = Store(spark, str(tmp_path / "s"))
    r = np.random.default_rng(1)
    for t in ("AA", "BB"):
        p = 100 * np.cumprod(1 + r.normal(5e-4, 0.01, 120))
        store.write_prices(t, spark.createDataFrame([(day(i), *[float(v)] * 5, 1.0) for i, v in enumerate(p)], PRICES))
    assert command.main(["compare", "--store", store.base, "--tickers", "AA", "BB", "--lookback", "30", "--save", str(tmp_path / "runs")]) == 0
    assert command.main(["tearsheet", "--run", str(tmp_path / "runs" / "equal_weight"), "--out", str(tmp_path / "t.json")]) == 0
    assert json.loads((tmp_path / "t.json").read_text())["meta"]["strategy"] == "equal_weight"
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "positions": [{"ticker": "AA", "weight": 1.0}]}))
    monkeypatch.setattr(command, "Connectors", lambda spark, end=None: connectors.Connectors(spark, fake_get, end))
    assert command.main(["ingest", "--store", str(tmp_path / "t"), "--spec", str(tmp_path / "p.json")]) == 0
    assert "AA: 2 rows" in capsys.readouterr().out


def sequential_filter(x, mean, sd, transition):
    f, p, total, now = [], [], 0.0, numeric.stationary(transition)
    for v in x:
        d = np.exp(-0.5 * ((v - mean) / sd) ** 2) / sd / np.sqrt(2 * np.pi)
        p.append(now)
        f.append(now * d / (now @ d))
        total += np.log(now @ d)
        now = f[-1] @ transition
    return np.array(f), np.array(p), total


def test_filter_and_smoother_step_by_step():
    r = np.random.default_rng(6)
    for k, n in ((2, 1), (2, 2), (2, 777), (3, 500)):
        x = r.normal(0, 0.01, n)
        mean, sd = np.linspace(-1e-3, 1e-3, k), np.geomspace(0.004, 0.03, k)
        transition = np.full((k, k), 0.04 / (k - 1))
        np.fill_diagonal(transition, 0.96)
        f, p, total = sequential_filter(x, mean, sd, transition)
        got = numeric.hamilton_filter(x, mean, sd, transition)
        assert np.allclose(got[0], f, atol=1e-10) and np.allclose(got[1], p, atol=1e-10) and abs(got[2] - total) < 1e-7 * max(1, abs(total))
        s = f.copy()
        for t in range(n - 2, -1, -1):
            s[t] = f[t] * (transition @ (s[t + 1] / p[t + 1]))
        assert np.allclose(numeric.kim_smoother(got[0], got[1], transition), s, atol=1e-9)
    far = numeric.hamilton_filter(np.array([0.0, 5.0, 0.0]), np.zeros(2), np.array([0.001, 0.002]), np.array([[0.9, 0.1], [0.1, 0.9]]))
    assert np.isfinite(far[0]).all() and np.isfinite(far[2])


def test_as_of_by_spans(spark):
    r = np.random.default_rng(2)
    right = [(int(k), day(int(t)), float(v)) for k, t, v in zip(r.integers(0, 3, 60), r.choice(400, 60, replace=False), r.normal(size=60))]
    left = [(int(k), day(int(t))) for k, t in zip(r.integers(0, 4, 80), r.integers(-5, 420, 80))]
    a, b = spark.createDataFrame(left, "k int, at date"), spark.createDataFrame(right, "k int, seen date, v double")
    key = lambda x: (x[0], x[1])
    want = sorted(((k, t, max(((s, v) for j, s, v in right if j == k and s <= t - dt.timedelta(days=7)), default=(None, None))[1]) for k, t in left), key=key)
    for split in (None, "month", "year"):
        assert sorted(map(tuple, panel.as_of(a, b, ["k"], "at", "seen", ["v"], 7, split).collect()), key=key) == want


def test_drawdowns_keep_their_state_between_batches(spark, tmp_path):
    from marlstone.streaming import twins

    r = np.random.default_rng(3)
    bars = [(day(i), t, float(v)) for i in range(30) for t, v in zip("AB", 100 + r.normal(0, 5, 2))]
    schema = "date date, ticker string, price double"
    folder = str(tmp_path / "bars")
    q = None
    for part in (bars[:20], bars[20:44], bars[44:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        q = twins.drawdown_stream(spark.readStream.schema(schema).parquet(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    whole = spark.createDataFrame(bars, schema).groupBy("ticker").applyInPandas(twins.drawdowns_of_batch, twins.DRAWDOWNS)
    assert len(got) == 60 and got == sorted(tuple(x) for x in whole.collect())
