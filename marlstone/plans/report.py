"""Reports as JSON payloads: sections of stats and tables over shared, cached models; a failing section reports its error."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import optimizers
from marlstone.operators import covariance as C
from marlstone.operators import factors as FA
from marlstone.operators import networks, panel, performance, regimes, stress
from marlstone.plans import backtest
from marlstone.sources.spec import COVARIANCES, PortfolioSpec

# ---------------------------------------------------------------- encoding


def safe(value):
    """The value as JSON knows it: numbers of numpy as Python's, NaN and infinities as null, dates as text."""
    if isinstance(value, Mapping):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return safe(value.tolist())
    if isinstance(value, (list, tuple, set)):
        return [safe(v) for v in value]
    if isinstance(value, np.generic):
        return safe(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def dumps(payload, indent: int | None = None) -> str:
    return json.dumps(safe(payload), allow_nan=False, indent=indent)


def stat(label: str, value, unit: str = "") -> dict:
    return {"label": label, "value": safe(value), "unit": unit}


def table(title: str, rows: DataFrame | Sequence[Mapping], order: Sequence[str] = ()) -> dict:
    """A table of a report's size: what stands in it is an aggregate, not raw rows."""
    if isinstance(rows, DataFrame):
        columns = rows.columns
        data = [[r[c] for c in columns] for r in (rows.orderBy(*order) if order else rows).collect()]
    else:
        rows = list(rows)
        columns = list(rows[0]) if rows else []
        data = [[r[c] for c in columns] for r in rows]
    return {"title": title, "columns": columns, "rows": safe(data)}


def section(stats: Sequence[dict] = (), tables: Sequence[dict] = (), notes: Sequence[str] = ()) -> dict:
    return {"stats": list(stats), "tables": list(tables), "notes": list(notes)}


def standalone(payload) -> str:
    """One HTML page that carries its payload as JSON."""
    text = dumps(payload).replace("</", "<\\/")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Report</title></head><body><pre id="out"></pre><script type="application/json" id="payload">{text}</script><script>document.getElementById("out").textContent = JSON.stringify(JSON.parse(document.getElementById("payload").textContent), null, 2)</script></body></html>'


# ---------------------------------------------------------------- a book's analysis


class Analysis:
    """What the sections share, each computed once."""

    def __init__(self, spec: PortfolioSpec, returns: panel.ReturnSeries, factors: DataFrame | None = None):
        self.spec, self.returns, self.factors = spec, returns, factors
        self.weights = {t: w for t, w in spec.portfolio().weights.items() if t in returns.tickers}
        self.ppy = returns.periods_per_year
        self.spark = returns.data.sparkSession

    @cached_property
    def data(self) -> DataFrame:
        return self.returns.data.cache()

    @cached_property
    def book(self) -> DataFrame:
        return panel.portfolio_returns(self.data, self.weights).withColumn("track", F.lit("book")).cache()

    @cached_property
    def cov(self) -> C.CovarianceResult:
        return C.estimate(self.data, list(self.returns.tickers), COVARIANCES[self.spec.cov_method], self.ppy, annualise=True)

    @cached_property
    def regimes(self) -> DataFrame:
        s = self.spec.settings
        return regimes.fit_regimes(self.book, ["track"], s.regime_states, s.regime_search_reps).cache()

    @cached_property
    def aligned(self) -> FA.AlignedFactors:
        names = [c for c in self.factors.columns if c not in ("date", "RF")]
        return FA.align(self.book, self.factors, names, self.returns.calendar)

    @cached_property
    def model(self) -> FA.FactorModel:
        return FA.factor_model(self.aligned, self.spec.settings.hac_lags, self.ppy)


def overview(a: Analysis) -> dict:
    m = performance.metrics(a.book, ["track"], a.ppy).drop("track").head().asDict()
    roll = performance.rolling_volatility(a.book, a.spec.settings.rolling_window, a.ppy, ["track"]).groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(F.max_by("volatility", "date").alias("volatility"))
    return section([stat(k, v) for k, v in m.items()], [table("Metrics by asset", performance.metrics(a.data, ["ticker"], a.ppy), ["ticker"]), table("Volatility at month ends", roll, ["month"])])


def risk(a: Analysis) -> dict:
    rows = C.risk_decomposition(a.cov.table(a.spark).where("a <= b"), panel.weights_frame(a.data, a.weights))
    heavy = [r["ticker"] for r in C.overweight(rows).collect()]
    return section([stat("volatility", a.cov.values is not None and rows.head()["sigma"]), stat("condition number", a.cov.condition_number()), stat("smallest eigenvalue", a.cov.smallest_eigenvalue())], [table("Risk contributions", rows.drop("sigma"), ["ticker"])], [f"{t} carries over 1.5 times its weight in risk" for t in heavy])


def tail(a: Analysis) -> dict:
    s = a.spec.settings
    return section(tables=[table("Tail measures", C.historical_tail(a.book, ["track"], s.var_confidence)), table("Extreme value fit", C.evt_tail(a.data.unionByName(a.book.select("date", F.lit("book").alias("ticker"), "ret")), ["ticker"], s.var_confidence, s.evt_threshold_quantile), ["ticker"])])


def factor_section(a: Analysis) -> dict:
    if a.factors is None:
        raise ValueError("no factors are stored")
    m = a.model
    parts = FA.attribution(a.aligned, m)
    shares = FA.factor_risk(m, FA.factor_covariance(a.aligned, a.ppy))
    return section([stat("annual alpha", m.annual_alpha), stat("R squared", m.r_squared), stat("specific risk", m.annual_idiosyncratic)], [table("Regression", m.table(a.spark)), table("Attribution", [{"part": k, "mean": v} for k, v in {"alpha": parts["alpha"], **parts["factors"]}.items()]), table("Risk shares", [{"factor": k, "share": v} for k, v in shares["shares"].items()])], [a.aligned.coverage()])


def structure(a: Analysis) -> dict:
    s, rho, names = a.spec.settings, a.cov.correlation(), list(a.returns.tickers)
    pca = FA.principal_components(a.cov.values, names, s.pca_method)
    c = networks.clusters(rho, names, s.n_clusters)
    tree = networks.spanning_tree(rho, names)
    hidden = FA.concentration(a.weights, a.cov.values, names)
    return section([stat(k, hidden[k]) for k in ("effective_bets", "effective_positions", "top_share", "verdict")], [table("Explained", [{"component": k + 1, "share": v} for k, v in enumerate(pca.explained)]), table("Clusters", [{"ticker": t, "cluster": c.labels[t]} for t in c.order]), table("Spanning tree", tree.table(a.spark)), table("Hubs", [{"ticker": t, "degree": d} for t, d in tree.hubs()])])


def stress_section(a: Analysis) -> dict:
    out = stress.replay_assets(a.data, a.weights, stress.scenarios(a.spark))
    tables = [table("Historical replays", out, ["pnl"])]
    if a.factors is not None:
        known = {k: v for k, v in stress.FACTOR_SHOCKS.items() if set(v) <= set(a.model.names)}
        if known:
            tables.append(table("Factor shocks", stress.factor_shock(a.spark, a.model, known), ["pnl"]))
    worst = stress.worst(out).head()
    return section([stat("worst scenario", worst["scenario"]), stat("its return", worst["pnl"])], tables)


def regime_section(a: Analysis) -> dict:
    rows = a.book.join(a.regimes.select("date", "state"), "date")
    names = regimes.labels(a.spec.settings.regime_states)
    last = a.regimes.agg(F.max_by("filtered", "date")).head()[0]
    return section([stat("current regime", names[int(np.argmax(last))]), *[stat(f"probability of {n}", p) for n, p in zip(names, last)]], [table("By regime", regimes.state_statistics(rows, a.ppy), ["state"]), table("Filtered against smoothed", regimes.disagreement(a.regimes)), table("Average correlation", regimes.state_correlation(a.data.join(a.regimes.select("date", "state"), "date")), ["state"])])


def optimisation(a: Analysis) -> dict:
    names, s = list(a.returns.tickers), a.spec.settings
    mean = {r["ticker"]: r["m"] * a.ppy for r in a.data.groupBy("ticker").agg(F.avg("ret").alias("m")).collect()}
    mu = np.array([mean[t] for t in names])
    books = [optimizers.min_variance(a.cov.values, names), optimizers.risk_parity(a.cov.values, names), optimizers.hrp(a.cov.values, names)]
    w, vols = optimizers.random_books(a.cov.values, s.cloud_points)
    return section([stat(f"{b.method} volatility", b.volatility) for b in books], [table("Weights", [{"method": b.method, "ticker": t, "weight": x} for b in books for t, x in b.ranked()]), table("Frontier", [{"target": p["target"], "volatility": p["volatility"]} for p in optimizers.efficient_frontier(a.cov.values, mu, names, points=s.frontier_points)]), table("Random books", [{"return": r, "volatility": v} for r, v in zip(w @ mu, vols)])])


SECTIONS: list[tuple[str, str, Callable[[Analysis], dict]]] = [
    ("overview", "Overview", overview),
    ("risk", "Risk", risk),
    ("tail", "Tail risk", tail),
    ("factors", "Factors", factor_section),
    ("structure", "Structure", structure),
    ("stress", "Stress", stress_section),
    ("regimes", "Regimes", regime_section),
    ("optimization", "Optimisation", optimisation),
]


def build(sections, subject, meta: Mapping, only: Sequence[str] | None = None) -> dict:
    out = []
    for name, title, make in sections:
        if only and name not in only:
            continue
        try:
            out.append({"id": name, "title": title, **make(subject)})
        except Exception as e:  # noqa: BLE001  one section's failure is its panel's content
            out.append({"id": name, "title": title, "error": f"{type(e).__name__}: {e}"})
    return safe({"meta": dict(meta), "sections": out})


def analysis_payload(spec: PortfolioSpec, returns: panel.ReturnSeries, factors: DataFrame | None = None, only: Sequence[str] | None = None) -> dict:
    a = Analysis(spec, returns, factors)
    return build(SECTIONS, a, {"name": spec.name, "description": spec.describe(), "calendar": returns.calendar.value, "tickers": list(returns.tickers)}, only)


# ---------------------------------------------------------------- tearsheets of runs


#: The share of folds that one strategy must win for the selection to count as stable.
STABLE = 0.7


def run_warnings(r: backtest.BacktestResult) -> list[str]:
    """Reasons to distrust a run."""
    out = [] if r.meta.is_reproducible else ["The code of this run was not committed: it can't be repeated from its commit."]
    if not r.folds:
        out.append("The run has no walk-forward folds: all its results are in sample.")
    stable = r.metrics.get("selection_stability")
    if stable is not None and stable < STABLE:
        out.append(f"The strategy that won most folds won {stable:.0%} of them: the curve mixes rules instead of testing one.")
    return out


def run_overview(r: backtest.BacktestResult) -> dict:
    ppy = r.meta.config.get("periods_per_year", 252)
    m = performance.metrics(r.equity_curve.withColumn("track", F.lit("run")), ["track"], ppy, rate=0.0).drop("track").head().asDict()
    lag = r.meta.config.get("publication_lag_days", 0)
    notes = [] if lag else ["No publication lag: every input counts as known on its own date."]
    return section([stat(k, v) for k, v in {**m, **{k: v for k, v in r.metrics.items() if not isinstance(v, (list, dict))}}.items()], notes=notes)


def run_trading(r: backtest.BacktestResult) -> dict:
    t = r.trades.withColumn("delta", F.col("delta_weight")).withColumn("run_id", F.lit("run")).withColumn("kind", F.lit("trade"))
    days = max(1, r.equity_curve.count())
    cost = t.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).head()[0]
    return section([stat("cost a year", cost / days * 252)], [table("By asset", backtest.trades_by_asset(t).drop("run_id"), ["ticker"]), table("By date", backtest.trades_by_date(t).drop("run_id"), ["date"])])


def run_exposure(r: backtest.BacktestResult) -> dict:
    return section(tables=[table("Exposure at month ends", r.equity_curve.groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(F.max_by("gross", "date").alias("gross"), F.max_by("net", "date").alias("net")), ["month"])])


def run_folds(r: backtest.BacktestResult) -> dict:
    """The folds with their winners; the selection comes with the run's metrics (fold_selection, selection_stability)."""
    if not r.folds:
        raise ValueError("the run has no folds")
    picks = {s["fold"]: s for s in r.metrics.get("fold_selection") or []}
    rows = [{**{k: getattr(f, k) for k in ("number", "train_start", "train_end", "test_start", "test_end")}, "winner": picks.get(f.number, {}).get("winner"), "score": picks.get(f.number, {}).get("score")} for f in r.folds]
    winners = sorted(p["winner"] for p in picks.values())
    stats = [stat("folds", len(rows)), stat("selection stability", r.metrics.get("selection_stability")), stat("most chosen", max(winners, key=winners.count) if winners else None)]
    return section(stats, [table("Folds", rows)])


RUN_SECTIONS = [("overview", "Overview", run_overview), ("risk", "Exposure", run_exposure), ("trading", "Trading", run_trading), ("walkforward", "Walk-forward", run_folds)]


def tearsheet(result: backtest.BacktestResult, only: Sequence[str] | None = None) -> dict:
    return build(RUN_SECTIONS, result, {"strategy": result.meta.strategy, "commit": result.meta.commit, "warnings": run_warnings(result)}, only)
