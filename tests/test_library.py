"""Operators, store, quality, backtests and streams on a local session."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.calendar import Calendar
from marlstone.operators import covariance, factors, panel, performance, regimes, stress
from marlstone.plans import backtest, quality, strategies, walkforward
from marlstone.sources import ingest, parsers, registry
from marlstone.sources.store import Store

START = dt.date(2022, 1, 3)


def day(i):
    return START + dt.timedelta(days=i)


def long_frame(spark, matrix, tickers="ABCDEFG", value="ret"):
    rows = [(day(i), tickers[j], float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, f"date date, ticker string, {value} double")


@pytest.fixture(scope="module")
def normal(spark):
    m = np.random.default_rng(42).normal(5e-4, 0.01, (300, 3))
    return m, long_frame(spark, m).cache()


def test_intersection_never_fills(spark):
    rows = [(day(i), "C", 100.0 + i) for i in range(14)] + [(day(i), "W", 50.0 + i) for i in range(14) if day(i).weekday() < 5]
    df = spark.createDataFrame(rows, "date date, ticker string, price double")
    got = panel.ReturnSeries.from_prices(df, ["C", "W"]).data.where("ticker = 'C'").orderBy("date").collect()
    days = [day(i) for i in range(14) if day(i).weekday() < 5]
    assert [r.date for r in got] == days[1:]
    price = {r[0]: r[2] for r in rows if r[1] == "C"}
    assert all(abs(r.ret - (price[b] / price[a] - 1)) < 1e-12 for r, a, b in zip(got, days, days[1:]))


def test_metrics_match_numpy(spark, normal):
    m, df = normal
    got = {r.ticker: r for r in performance.metrics(df, ["ticker"]).collect()}
    for j, t in enumerate("ABC"):
        x = m[:, j]
        g = np.cumprod(1 + x)
        dd = g / np.maximum.accumulate(g) - 1
        longest = best = 0
        for v in dd:
            longest = longest + 1 if v < 0 else 0
            best = max(best, longest)
        r = got[t]
        assert np.isclose(r.total_return, g[-1] - 1) and np.isclose(r.volatility, x.std(ddof=1) * 252**0.5) and np.isclose(r.max_drawdown, dd.min())
        assert r.max_drawdown_duration == best and np.isclose(r.var_hist, -np.percentile(x, 5)) and np.isclose(r.cvar_hist, -x[x <= np.percentile(x, 5)].mean())
        assert np.isclose(r.sharpe, (x.mean() - 0.04 / 252) / x.std(ddof=1) * 252**0.5)


def test_flat_tracks_give_zeros(spark):
    r = performance.metrics(long_frame(spark, [[0.0]] * 5), ["ticker"]).head()
    assert r.sharpe == r.calmar == r.max_drawdown == 0 and r.max_drawdown_duration == 0


def test_covariances(spark, normal):
    m, df = normal
    tickers = ["A", "B", "C"]
    assert np.allclose(covariance.estimate(df, tickers).values, np.cov(m, rowvar=False), atol=1e-12)
    w = 0.94 ** np.arange(len(m))[::-1]
    assert np.allclose(covariance.estimate(df, tickers, "ewma").values, (m * (w / w.sum())[:, None]).T @ m, atol=1e-12)
    for method in ("ledoit_wolf", "constant_correlation"):
        c = covariance.estimate(df, tickers, method)
        assert 0 <= c.shrinkage <= 1 and c.is_psd() and np.isfinite(c.values).all()
    flat = long_frame(spark, np.column_stack([m[:, :2], np.zeros(len(m))]))
    c = covariance.estimate(flat, tickers, "constant_correlation")
    assert np.isfinite(c.values).all() and (c.values[2] == 0).all()
    with pytest.raises(ValueError):
        covariance.estimate(df, tickers, "odd")


def test_risk_shares_sum_to_one(spark, normal):
    _, df = normal
    rows = covariance.risk_decomposition(covariance.covariance(df), panel.weights_frame(df, {"A": 0.5, "B": 0.3, "C": 0.2})).collect()
    assert abs(sum(r.share for r in rows) - 1) < 1e-12 and abs(sum(r.contribution for r in rows) - rows[0].sigma) < 1e-12


def test_factor_model_recovers(spark):
    r = np.random.default_rng(123)
    f = r.normal(0, 0.01, (2000, 3))
    y = 2e-4 + f @ [1.2, -0.4, 0.6] + r.normal(0, 0.003, 2000)
    rows = [(day(i), float(y[i]), *map(float, f[i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "date date, ret double, m double, s double, h double")
    a = factors.align(df.select("date", "ret"), df.select("date", "m", "s", "h"), ["m", "s", "h"])
    model = factors.factor_model(a)
    assert np.allclose(model.betas, [1.2, -0.4, 0.6], atol=0.03) and abs(model.alpha - 2e-4) < 2e-4 and model.r_squared > 0.9
    classical = factors.factor_model(a, hac_lags=None)
    x = np.column_stack([np.ones(2000), f])
    res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(classical.std_errors, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / 1996), rtol=1e-6)
    part = factors.attribution(a, model)
    assert abs(part["error"]) < 1e-10
    risk = factors.factor_risk(model, factors.factor_covariance(a))
    assert abs(sum(risk["shares"].values()) + risk["specific"] / risk["total"] - 1) < 1e-10
    betas = factors.rolling_betas(a, 250).orderBy("date").collect()
    b = np.linalg.lstsq(x[:250], y[:250], rcond=None)[0]
    assert len(betas) == 1751 and np.allclose([betas[0].alpha, betas[0].m, betas[0].s, betas[0].h], b, atol=1e-8)
    with pytest.raises(KeyError):
        factors.align(df.select("date", "ret"), df.select("date", "m"), ["zz"])


def test_regimes_fit_in_groups(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(0, 0.005, 200), r.normal(0, 0.03, 100)])
    df = spark.createDataFrame([("t", day(i), float(v)) for i, v in enumerate(x)], "track string, date date, ret double")
    rows = regimes.fit_regimes(df, ["track"], restarts=2).orderBy("date").collect()
    assert len(rows) == 300 and np.mean([q.state for q in rows[210:]]) > 0.9
    assert regimes.align_states(spark.createDataFrame([(day(-5),)], "date date"), spark.createDataFrame([(day(0), 1)], "date date, state int")).head().state == -1


def test_stress(spark, normal):
    _, df = normal
    out = {r.scenario: r for r in stress.replay_assets(df, {"A": 0.6, "Z": 0.4}, stress.scenarios(spark, [("w", str(day(10)), str(day(60))), ("none", "1990-01-01", "1990-02-01")])).collect()}
    assert set(out) == {"w"} and out["w"].covered == 0.6 and out["w"].max_drawdown <= 0
    with pytest.raises(KeyError):
        stress.shock(spark, {"a": 1.0}, {"s": {"b": 1.0}})


def test_quality_findings(spark):
    rows = [(day(i), "X", 100.0 + i % 7, "trading_days", "equity") for i in range(300)]
    rows[50] = (day(50), "X", None, "trading_days", "equity")
    rows[60] = (day(60), "X", -1.0, "trading_days", "equity")
    rows[70] = (day(70), "X", 500.0, "trading_days", "equity")
    rows += [(day(i), "Y", 10.0, "trading_days", "equity") for i in range(280) if not 100 <= i < 110]
    rows += [(day(2 * i), "Z", 10.0 + i % 2, "continuous", "crypto") for i in range(30)]
    found = {(r.ticker, r.check): r for r in quality.report(spark.createDataFrame(rows, "date date, ticker string, adj_close double, calendar string, asset_class string")).collect()}
    assert {("X", "missing_values"), ("X", "non_positive"), ("X", "return_outliers"), ("Y", "stale_prices"), ("Y", "calendar_gaps"), ("Y", "observation_gaps"), ("Z", "observation_gaps"), ("Z", "short_history")} <= set(found)
    assert found["X", "return_outliers"].severity == "critical" and found["Z", "observation_gaps"].severity == "warning" and found["Y", "observation_gaps"].severity == "info"
    assert abs(json.loads(found["X", "return_outliers"].detail)["events"][0]["return"]) > 3


def test_store_upserts_and_sql(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = "date date, open double, high double, low double, close double, adj_close double, volume double"
    frame = lambda a, b, p: spark.createDataFrame([(day(i), p, p, p, p, p + i, 1.0) for i in range(a, b)], schema)
    assert store.write_prices("AA", frame(0, 10, 100.0)) == 10 and store.write_prices("BB", frame(0, 8, 50.0)) == 8
    assert store.write_prices("AA", frame(5, 12, 200.0)) == 12
    assert store.sql("SELECT count(*) AS n FROM prices() WHERE ticker = 'AA' AND adj_close >= 200").head().n == 7
    assert store.available_tickers() == ["AA", "BB"] and store.last_date("AA") == day(11)
    wide = store.read_prices(["AA", "BB", "missing"])
    assert wide.columns == ["date", "AA", "BB"] and wide.count() == 12
    store.write_asset("AA", "continuous", "crypto", "x")
    rs = store.read_returns(["AA", "BB"])
    assert rs.calendar is Calendar.TRADING_DAYS and rs.n_obs() == 7 and store.calendar_for("AA") is Calendar.CONTINUOUS
    with pytest.raises(ValueError):
        store.read_returns(["missing"])
    store.write_series(spark.createDataFrame([(day(0), "f", 1.0, "s"), (day(0), "g", 2.0, "s")], "date date, factor string, value double, source string"), "factors")
    store.write_series(spark.createDataFrame([(day(0), "f", 9.0, "s")], "date date, factor string, value double, source string"), "factors")
    assert store.read_factors().head().asDict() == {"date": day(0), "f": 9.0, "g": 2.0}


def test_ingestion(spark, tmp_path):
    store = Store(spark, str(tmp_path / "in"))
    asked = []

    def prices(t, since):
        asked.append((t, since))
        if t == "BAD":
            raise OSError("no such source")
        return spark.createDataFrame([(day(i), t, 1.0, 1.0, 1.0, 1.0, 1.0 + i, 0.0) for i in range(3)], "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double").where(F.col("date") >= since)

    p = ingest.Pipeline(store, prices)
    out = p.update_prices(["BTC-USD", "BAD"], "2022-01-01", today=day(2))
    assert [r.ok for r in out] == [True, False] and store.assets()["BTC-USD"]["calendar"] == "continuous"
    p.update_prices(["BTC-USD"], today=day(2))
    assert len(asked) == 2
    calls = []
    with pytest.raises(RuntimeError):
        ingest.with_retry(lambda: calls.append(1) or (_ for _ in ()).throw(TimeoutError()), delay=0)
    assert len(calls) == 3


def test_parsers(spark):
    fred = parsers.fred_csv(spark, text="observation_date,DGS10\n2024-01-02,3.95\n2024-01-03,.\n2024-01-04,4.01\n").collect()
    assert [(str(r.date), r.value) for r in fred] == [("2024-01-02", 3.95), ("2024-01-04", 4.01)]
    text = "Some words\n\n,Mkt-RF,SMB,RF\n20240102, -0.50, 0.10, 0.02\n20240103, 1.00, oops, 0.02\n\n Annual\n2023, 1.0, 2.0, 3.0\n"
    rows = parsers.french_text(spark, text).collect()
    assert len(rows) == 5 and rows[0].factor == "Mkt-RF" and abs(rows[0].value + 0.005) < 1e-12
    ms = [1704067200000, 1704067200000 + 3600000, 1704153600000]
    candles = parsers.exchange_candles(spark.createDataFrame([(t, 1.0, 2.0, 0.5, float(i), 9.0) for i, t in enumerate(ms)], "ts long, open double, high double, low double, close double, volume double"), "BTC-USD").collect()
    assert [(str(r.date), r.close, r.adj_close) for r in candles] == [("2024-01-01", 1.0, 1.0), ("2024-01-02", 2.0, 2.0)]
    pages = {0: [[0], [1]], 2: [[2], [3]], 4: [[4]]}
    assert parsers.paginate(lambda s, n: pages.get(s, []), 0, 2) == [[0], [1], [2], [3], [4]]
    assert registry.available_rates("EUR") == ["EUR_DFR", "EUR_ESTR", "EUR_MRO"] and registry.publication_lag_days("factors", "FF5") == 45
    with pytest.raises(ValueError):
        registry.publication_lag_days("rates", "nope")


class ChaseToday:
    name = "chase"

    def target_weights(self, context):
        return {context.universe[int(np.argmax(context.returns[-1]))]: 1.0}


def test_yesterdays_winner_earns_nothing(spark):
    m = np.zeros((400, 2))
    m[::2, 0] = m[1::2, 1] = 0.10
    out = backtest.run_all(long_frame(spark, m), [ChaseToday()], backtest.BacktestConfig(rebalance="daily", lookback=5, costs=backtest.CostModel.free()))
    assert abs(backtest.run_metrics(out).head().final_equity - 1.0) < 1e-12


def test_contexts_refuse_the_future():
    args = dict(universe=("A",), returns=np.zeros((2, 1)), covariance=np.zeros((1, 1)), weights={})
    with pytest.raises(strategies.LookAheadError):
        strategies.Context(as_of=day(0), dates=(day(0), day(1)), **args)
    with pytest.raises(strategies.LookAheadError):
        strategies.Context(as_of=day(5), dates=(day(0), day(1)), regime=regimes.RegimeState((0.5, 0.5), ("calm", "stress"), day(4)), publication_lag_days=3, **args)
    with pytest.raises(ValueError):
        strategies.Context(as_of=day(5), dates=(day(0), day(1)), **{**args, "weights": {"Z": 1.0}})


def test_relational_and_grouped_runs_agree(spark, normal):
    _, df = normal
    grouped = backtest.run_all(df, [strategies.FixedWeights({"A": 0.5, "B": 0.3, "C": 0.2})], backtest.BacktestConfig(lookback=21, dust=0.0))
    a = {r.date: r.equity for r in grouped.where("kind = 'equity'").collect()}
    b = {r.date: r.equity for r in backtest.run_static(df, panel.weights_frame(df, {"A": 0.5, "B": 0.3, "C": 0.2}), "monthly", 21).collect()}
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-10 for d in a)
    fills, cost, got = backtest.rebalanced({"A": 0.5}, {"B": 1.0}, backtest.CostModel())
    assert abs(sum(f[2] for f in fills) - cost) < 1e-15 and got == {"B": 1.0}


def test_results_round_trip(spark, normal, tmp_path):
    _, df = normal
    config = backtest.BacktestConfig(lookback=42)
    rows = backtest.run_all(df, [strategies.MinimumVariance()], config)
    dates = [day(i) for i in range(300)]
    folds = walkforward.make_folds(dates, 3, min_train=100)
    result = backtest.BacktestResult.of(rows, "min_variance", backtest.RunMeta.create(strategies.MinimumVariance(), config, "ABC"), {"x": float("nan")})
    result.folds = folds
    result.save(str(tmp_path / "run"))
    back = backtest.BacktestResult.load(spark, str(tmp_path / "run"))
    assert back.metrics == {"x": None} and back.folds == folds and back.equity_curve.count() == result.equity_curve.count()
    assert back.out_of_sample().agg(F.min("date")).head()[0] >= folds[0].test_start
    with pytest.raises(ValueError):
        backtest.BacktestResult(df, df, df, {}, back.meta)
    with pytest.raises(strategies.LookAheadError):
        backtest.Fold(0, day(0), day(5), day(5), day(9))


class Always:
    def __init__(self, ticker):
        self.name, self.ticker = f"only_{ticker}", ticker

    def target_weights(self, context):
        return {self.ticker: 1.0}


def test_selection_is_blind(spark):
    m = np.empty((600, 2))
    noise = np.random.default_rng(5).normal(0, 1e-4, (600, 2))
    m[:300], m[300:] = [0.002, -0.001], [-0.001, 0.002]
    df = long_frame(spark, m + noise)
    folds = walkforward.make_folds([day(i) for i in range(600)], 1, min_train=300)
    rows, selection = walkforward.walk_forward(df, [Always("A"), Always("B")], folds, backtest.BacktestConfig(lookback=20, costs=backtest.CostModel.free()))
    assert selection.head().winner == "only_A"
    curve = rows.where("kind = 'equity'").orderBy("date").collect()
    assert curve[-1].equity < 0.8 and curve[0].equity == 1.0 and walkforward.stability(selection).head().share == 1.0


def test_streams_equal_their_batches(spark, tmp_path):
    from marlstone.session import read_table
    from marlstone.streaming import twins

    events = read_table(spark, "/root/testdata/sf0.001", "events")
    stream = twins.daily_bars(twins.event_stream(spark, "/root/testdata/sf0.001", events.schema, pattern="events.parquet"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("ticker")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, spark.table("bars").select("date", "ticker", "n").collect())) == sorted(map(tuple, want.collect()))


def test_every_oracle_has_a_query():
    from marlstone.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 80
