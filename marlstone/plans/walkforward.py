"""Walk-forward evaluation: choose on the past, earn on the future, chain what was earned."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.plans.backtest import RUN_SCHEMA, BacktestConfig, Fold, market_series, run_one

log = logging.getLogger(__name__)


def make_folds(dates: Sequence, n_folds: int = 5, scheme: str = "expanding", min_train: int = 252, train_window: int | None = None) -> list[Fold]:
    """Consecutive test ranges of about equal length after ``min_train`` dates; training grows or rolls."""
    if scheme not in ("expanding", "rolling"):
        raise ValueError(f"unknown scheme {scheme!r}")
    dates = sorted(dates)
    if n_folds < 1 or len(dates) <= min_train + n_folds:
        raise ValueError(f"{len(dates)} dates are too few for {n_folds} folds after {min_train}")
    edges = np.linspace(min_train, len(dates), n_folds + 1).astype(int)
    out = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        first = 0 if scheme == "expanding" else max(0, a - (train_window or min_train))
        out.append(Fold(k, dates[first], dates[a - 1], dates[a], dates[b - 1]))
    return out


def growth_over_risk(rets: np.ndarray, periods_per_year: int) -> float:
    """The default score: compound growth over volatility; minus infinity without volatility."""
    if len(rets) < 2 or (vol := float(np.std(rets, ddof=1)) * math.sqrt(periods_per_year)) <= 0:
        return -math.inf
    total = float(np.prod(1 + rets))
    return (total ** (periods_per_year / len(rets)) - 1 if total > 0 else -1.0) / vol


def walk_forward(
    returns: DataFrame,
    candidates: Sequence | Callable[[], Sequence],
    folds: Sequence[Fold],
    config: BacktestConfig = BacktestConfig(),
    score: Callable[[np.ndarray, int], float] = growth_over_risk,
    market: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, selection). Every fold x candidate is scored on the fold's training rows alone, in groups that run side by
    side; each fold's winner (the first of equals) runs over training and test rows, and its test rows are kept, each
    fold's equity rebased to its first and chained to the folds before. ``market``: (date, ret), what regimes are fitted to.

    A candidate that can't be run on a fold's training rows (too little history, no solution) is left out there, a fold
    without any candidate or whose winner fails on its test rows is left out, and no fold at all is an error. ``rows`` has
    the fold; ``selection``: fold, winner, score, the scores of all, the test range.
    """
    pool = list(candidates() if callable(candidates) else candidates)
    if not pool:
        raise ValueError("no candidates")
    spark = returns.sparkSession
    returns = returns.select("date", "ticker", "ret").persist()  # read once for training and once for the tests
    table = spark.createDataFrame([(f.number, f.train_start, f.train_end, f.test_end) for f in folds], "fold int, a date, b date, z date")
    market_dates, market_rets = market_series(market)

    def one(strategy, pdf):
        wide = pdf.pivot(index="date", columns="ticker", values="ret").sort_index().dropna()
        days = [d.date() if hasattr(d, "date") else d for d in wide.index]
        return run_one(strategy, days, wide.to_numpy(), list(wide.columns), config, market_dates, market_rets)

    def train(key, pdf):
        import pandas as pd

        try:
            found, reason = float(score(np.array([r[2] for r in one(pool[key[1]], pdf)["equity"]]), config.periods_per_year)), None
        except (ValueError, RuntimeError) as e:
            found, reason = None, str(e)
        return pd.DataFrame([(key[0], key[1], found, reason)], columns=["fold", "candidate", "score", "reason"])

    fan = returns.join(table, (F.col("date") >= F.col("a")) & (F.col("date") <= F.col("b"))).withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(len(pool) - 1))))
    scored = fan.select("fold", "candidate", "date", "ticker", "ret").groupBy("fold", "candidate").applyInPandas(train, "fold int, candidate int, score double, reason string").collect()  # folds x candidates rows
    by_fold: dict[int, list] = {}
    for r in sorted(scored, key=lambda r: (r["fold"], r["candidate"])):
        if r["reason"] is None:
            by_fold.setdefault(r["fold"], []).append((r["score"], r["candidate"]))
        else:
            log.warning("fold %d: %s is left out: %s", r["fold"], pool[r["candidate"]].name, r["reason"])
    winner = {f: max(s, key=lambda x: x[0])[1] for f, s in by_fold.items()}
    spans = {f.number: f for f in folds}

    def test(key, pdf):
        import pandas as pd

        columns = [*(c.split()[0] for c in RUN_SCHEMA.split(", ")), "fold"]
        fold = int(key[0])
        try:
            out = one(pool[winner[fold]], pdf)
        except (ValueError, RuntimeError):
            return pd.DataFrame([], columns=columns)
        first, name = spans[fold].test_start, pool[winner[fold]].name
        rows = [(name, "equity", d, None, e, r, g, n, None, None, None, fold) for d, e, r, g, n in out["equity"] if d >= first]
        rows += [(name, "position", d, t, None, None, None, None, w, None, None, fold) for d, t, w in out["positions"] if d >= first]
        rows += [(name, "trade", d, t, None, None, None, None, None, x, c, fold) for d, t, x, c in out["trades"] if d >= first]
        return pd.DataFrame(rows, columns=columns)

    whole = returns.join(table.where(F.col("fold").isin(list(winner))), (F.col("date") >= F.col("a")) & (F.col("date") <= F.col("z")))
    rows = whole.select("fold", "date", "ticker", "ret").groupBy("fold").applyInPandas(test, RUN_SCHEMA + ", fold int").persist()
    done = {r[0] for r in rows.select("fold").distinct().collect()}
    if not done:
        raise ValueError("no fold has out-of-sample rows")
    found = [(f, pool[w].name, dict((c, s) for s, c in by_fold[f])[w], {pool[c].name: s for s, c in by_fold[f]}, spans[f].test_start, spans[f].test_end) for f, w in winner.items() if f in done]
    selection = spark.createDataFrame(found, "fold int, winner string, score double, scores map<string,double>, test_start date, test_end date")
    return chained(rows), selection


def chained(rows: DataFrame) -> DataFrame:
    """Equity of the folds rebased to each fold's first value and multiplied through."""
    curve = rows.where("kind = 'equity'")
    ends = curve.groupBy("fold").agg((F.max_by("equity", "date") / F.min_by("equity", "date")).alias("__g"))
    base = ends.select("fold", F.coalesce(F.product("__g").over(W.partitionBy(F.lit(1)).orderBy("fold").rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)).alias("__base"))
    first = W.partitionBy("fold").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    out = curve.withColumn("equity", F.col("equity") / F.first("equity").over(first)).join(base, "fold").withColumn("equity", F.col("equity") * F.col("__base")).drop("__base")
    return out.unionByName(rows.where("kind <> 'equity'").select(*out.columns))


def selection_metrics(selection: DataFrame) -> dict:
    """What a saved walk-forward run carries about its selection: n_folds, fold_selection and selection_stability."""
    rows = [{**r.asDict(), "test_start": str(r["test_start"]), "test_end": str(r["test_end"])} for r in selection.orderBy("fold").collect()]
    best = stability(selection).head()
    return {"n_folds": len(rows), "fold_selection": rows, "selection_stability": best["share"] if best else 0.0}


def stability(selection: DataFrame) -> DataFrame:
    """(winner, n, share) of the strategy that won the most folds; of equals the first by name."""
    counts = selection.groupBy("winner").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).orderBy(F.desc("n"), "winner").limit(1)
