"""Prefix scans, sliding windows and selected quantiles against plain loops and one-task windows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import covariance, performance, scan


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, n in (("a", 700), ("b", 90), ("c", 1)):
        day = dt.date(2001, 1, 1)
        for r in rng.standard_normal(n) * 0.02:
            day += dt.timedelta(days=int(rng.integers(1, 5)))
            rows.append((k, day, float(r)))
    return spark.createDataFrame(rows, "ticker string, date date, ret double").repartition(4)


def plain(rows):
    """{(ticker, date): (growth, peak, drawdown, below)}"""
    out = {}
    for ticker in {r["ticker"] for r in rows}:
        growth, peak, below = 1.0, -math.inf, 0
        for r in sorted((r for r in rows if r["ticker"] == ticker), key=lambda r: r["date"]):
            growth *= 1 + r["ret"]
            peak = max(peak, growth)
            below = 0 if growth >= peak else below + 1
            out[ticker, r["date"]] = (growth, peak, growth / peak - 1, below)
    return out


@pytest.mark.parametrize("days", [7, 100, 100_000])
def test_growth_over_many_spans(tracks, days):
    truth = plain(tracks.collect())
    found = {(r["ticker"], r["date"]): (r["growth"], r["peak"], r["drawdown"], r["below"]) for r in scan.growth_scan(tracks, ["ticker"], days=days).collect()}
    assert found.keys() == truth.keys()
    for k, v in truth.items():
        assert np.allclose(found[k], v, rtol=1e-11, atol=1e-12)


def test_one_track_has_no_window_of_one_task(spark, tracks):
    one = tracks.where("ticker = 'a'").select("date", "ret")
    rows = scan.growth_scan(one, days=50)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    tasks = rows.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    truth = plain(tracks.where("ticker = 'a'").collect())
    assert {r["date"]: r["below"] for r in rows.collect()} == {d: v[3] for (_, d), v in truth.items()}
    assert "__span" in plan and tasks > 1


def test_metrics_by_spans_are_those_by_tracks(tracks):
    a = {r["ticker"]: r.asDict() for r in performance.metrics(tracks, ["ticker"]).collect()}
    b = {r["ticker"]: r.asDict() for r in performance.metrics(tracks, ["ticker"], span_days=60).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].keys() == b[k].keys()
        for c, v in a[k].items():
            assert v == b[k][c] or v is None or math.isclose(v, b[k][c], rel_tol=1e-9, abs_tol=1e-12) or (math.isnan(v) and math.isnan(b[k][c])), (k, c)


@pytest.mark.parametrize("window", [1, 2, 5, 63, 252])
def test_sliding_drawdown(tracks, window):
    rows = sorted(tracks.where("ticker <> 'c'").collect(), key=lambda r: (r["ticker"], r["date"]))
    truth = {}
    for ticker in ("a", "b"):
        own = [r for r in rows if r["ticker"] == ticker]
        for end in range(window, len(own) + 1):
            growth, peak, worst = 1.0, 0.0, 0.0
            for r in own[end - window : end]:
                growth *= 1 + r["ret"]
                peak = max(peak, growth)
                worst = min(worst, growth / peak - 1)
            truth[ticker, own[end - 1]["date"]] = worst
    found = {(r["ticker"], r["date"]): r["max_drawdown"] for r in scan.sliding_drawdown(tracks, window).collect() if r["ticker"] != "c"}
    assert found.keys() == truth.keys() and all(abs(found[k] - v) < 1e-12 for k, v in truth.items())
    assert "collect_list" not in performance.rolling_drawdown(tracks, window)._jdf.queryExecution().toString()


@pytest.mark.parametrize("window, decay", [(1, 0.94), (21, 0.94), (63, 0.97), (63, 1.0)])
def test_sliding_ewma(tracks, window, decay):
    rows = sorted(tracks.where("ticker = 'a'").collect(), key=lambda r: r["date"])
    x = [r["ret"] ** 2 for r in rows]
    w = [decay**k for k in range(window)]
    truth = {rows[e]["date"]: sum(w[k] * x[e - k] for k in range(window)) / sum(w) for e in range(window - 1, len(rows))}
    found = {r["date"]: r["v"] for r in scan.sliding_ewma(tracks.where("ticker = 'a'"), F.col("ret") * F.col("ret"), window, decay, ["ticker"], name="v").collect()}
    assert found.keys() == truth.keys() and all(math.isclose(found[k], v, rel_tol=1e-9) for k, v in truth.items())
    with pytest.raises(ValueError):
        scan.sliding_ewma(tracks, F.col("ret"), 100_000, 0.9, ["ticker"])


def test_rolling_risk_of_decaying_weights(tracks):
    """The default form against sums over each window."""
    a = tracks.where("ticker = 'a'").select("date", "ret")
    both = a.withColumn("ticker", F.lit("x")).unionByName(a.withColumns({"ticker": F.lit("y"), "ret": F.sin(F.col("ret") * 900) / 50}))
    book, window, decay = {"x": 0.7, "y": 0.3}, 21, 0.94
    rows = sorted(both.collect(), key=lambda r: (r["date"], r["ticker"]))
    r = np.array([q["ret"] for q in rows]).reshape(-1, 2)
    found = {(q["date"], q["ticker"]): q["share"] for q in covariance.rolling_risk_contribution(both, book, window, decay).collect()}
    w, book_w = decay ** np.arange(window)[::-1], np.array([0.7, 0.3])
    assert len(found) == 2 * (len(r) - window + 1)
    for e in range(window, len(r) + 1, 37):
        part = r[e - window : e]
        cov = (part * w[:, None]).T @ part / w.sum()
        share = book_w * (cov @ book_w) / (book_w @ cov @ book_w)
        assert np.allclose([found[rows[2 * (e - 1)]["date"], t] for t in ("x", "y")], share, atol=1e-10)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.999, 1.0])
def test_selected_quantiles_are_exact(spark, q):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 == 0, F.lit(0.25)).otherwise(F.pmod(F.xxhash64("id"), F.lit(999_983)) / 999_983).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(7, 1.5), (8, None), (8, float("nan")), (9, 1.0), (9, 2.0)], "k long, v double")).repartition(5)
    rows.createOrReplaceTempView("q_rows")
    truth = {r["k"]: (r["n"], r["v"]) for r in spark.sql(f"SELECT k, count(*) AS n, percentile(v, {q}D) AS v FROM q_rows WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY k").collect()}
    for most in (1_000_000, 500):
        found = {r["k"]: (r["n"], r["quantile"]) for r in scan.exact_quantiles(rows, ["k"], "v", q, most).collect()}
        assert found.keys() == truth.keys()
        assert all(found[k][0] == n and math.isclose(found[k][1], v, rel_tol=1e-12) for k, (n, v) in truth.items())


def test_odd_rows(spark):
    none = spark.createDataFrame([], "ticker string, date date, ret double")
    assert scan.growth_scan(none, ["ticker"]).collect() == [] and scan.sliding_drawdown(none, 5).collect() == []
    assert scan.exact_quantiles(none, ["ticker"], "ret", 0.5).collect() == []
    ticks = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), 0.01 * (-1) ** h) for h in range(24)], "at timestamp, ret double")
    found = scan.growth_scan(ticks, order="at", days=0.1).orderBy("at").collect()
    assert len(found) == 24 and math.isclose(found[-1]["growth"], (1.01 * 0.99) ** 12)
