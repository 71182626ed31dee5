"""Stress tests: replayed windows and shocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.operators.factors import AlignedFactors, FactorModel, factor_model
from marlstone.operators.panel import weights_frame, within_ranges
from marlstone.operators.performance import growth

# Windows of past crises (first and last day) and hypothetical moves, in each driver's own unit.
HISTORICAL = [
    ("GFC_2008", "2008-09-01", "2009-03-09"),
    ("EU_CRISIS_2011", "2011-07-01", "2011-10-03"),
    ("TAPER_2013", "2013-05-22", "2013-06-24"),
    ("VOLMAGEDDON_2018", "2018-10-01", "2018-12-24"),
    ("COVID_2020", "2020-02-19", "2020-03-23"),
    ("INFLATION_2022", "2022-01-01", "2022-10-14"),
]
FACTOR_SHOCKS = {
    "EQUITY_CRASH": {"Mkt-RF": -0.20},
    "VALUE_ROTATION": {"HML": 0.10, "Mkt-RF": -0.05},
    "QUALITY_FLIGHT": {"RMW": 0.08, "Mkt-RF": -0.10},
}
MACRO_SHOCKS = {
    "RATES_UP_100": {"rate_10y": 0.01},
    "RATES_UP_200": {"rate_10y": 0.02},
    "OIL_SHOCK": {"oil": 0.40},
    "USD_SHOCK": {"usd": 0.10},
    "VIX_SHOCK": {"vix": 20.0},
}


def scenarios(spark, windows: Sequence[tuple[str, str, str]] = HISTORICAL) -> DataFrame:
    return spark.createDataFrame(list(windows), "scenario string, start string, end string").select("scenario", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def replay_assets(returns: DataFrame, weights: dict[str, float], windows: DataFrame) -> DataFrame:
    """(scenario, n_days, pnl, max_drawdown, covered): a book held through all windows at once.

    Weights are scaled up to the assets that a window has; ``covered`` is the weight they had before."""
    rows = within_ranges(returns, windows, "start", "end").join(weights_frame(returns, weights), "ticker")
    present = rows.select("scenario", "ticker", "weight").distinct().groupBy("scenario").agg(F.sum("weight").alias("covered"))
    daily = rows.groupBy("scenario", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("__r")).join(present, "scenario")
    daily = daily.withColumn("ret", F.col("__r") / F.col("covered"))
    return growth(daily, ["scenario"]).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_days"), (F.max_by("growth", "date") - 1).alias("pnl"), F.min("drawdown").alias("max_drawdown"), F.first("covered").alias("covered"))


def replay_contributions(returns: DataFrame, weights: dict[str, float], windows: DataFrame) -> DataFrame:
    """(scenario, ticker, contribution): weight times the asset's compounded return in the window."""
    rows = within_ranges(returns, windows, "start", "end").join(weights_frame(returns, weights), "ticker")
    each = rows.groupBy("scenario", "ticker").agg((F.product(1 + F.col("ret")) - 1).alias("__g"), F.first("weight").alias("weight"))
    return each.select("scenario", "ticker", (F.col("weight") / F.sum("weight").over(W.partitionBy("scenario")) * F.col("__g")).alias("contribution"))


def _factor_days(factors: DataFrame, betas: dict[str, float], windows: DataFrame) -> DataFrame:
    book = factors.sparkSession.createDataFrame([(k, float(v)) for k, v in betas.items()], "factor string, beta double")
    return within_ranges(factors.join(book, "factor"), windows, "start", "end").withColumn("part", F.col("beta") * F.col("value"))


def replay_factors(factors: DataFrame, betas: dict[str, float], windows: DataFrame) -> DataFrame:
    """(scenario, n_days, pnl, max_drawdown) of betas times a long factor table (date, factor, value), compounded. A window
    without any date of the factors is not in the result; ``require_windows`` makes that an error."""
    daily = _factor_days(factors, betas, windows).groupBy("scenario", "date").agg(F.sum("part").alias("ret"))
    return growth(daily, ["scenario"]).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_days"), (F.max_by("growth", "date") - 1).alias("pnl"), F.min("drawdown").alias("max_drawdown"))


def replay_factor_contributions(factors: DataFrame, betas: dict[str, float], windows: DataFrame) -> DataFrame:
    """(scenario, factor, contribution): the sum of beta times the factor's daily value over the window."""
    return _factor_days(factors, betas, windows).groupBy("scenario", "factor").agg(F.sum("part").alias("contribution"))


def require_windows(results: DataFrame, windows: DataFrame) -> DataFrame:
    """``results``, or an error that names the windows without data."""
    if gone := sorted(r[0] for r in windows.select("scenario").join(results.select("scenario"), "scenario", "left_anti").collect()):
        raise ValueError(f"no data in the windows of {gone}")
    return results


def shock(spark, sensitivities: dict[str, float], shocks: dict[str, dict[str, float]]) -> DataFrame:
    """(scenario, pnl) of linear shocks; a driver that a shock leaves out doesn't move, an unknown driver is an error."""
    unknown = {f for moves in shocks.values() for f in moves} - set(sensitivities)
    if unknown:
        raise KeyError(f"no sensitivity to {sorted(unknown)}")
    moves = spark.createDataFrame([(s, f, float(m)) for s, moves in shocks.items() for f, m in moves.items()], "scenario string, driver string, move double")
    book = spark.createDataFrame([(f, float(b)) for f, b in sensitivities.items()], "driver string, beta double")
    return moves.join(book, "driver").groupBy("scenario").agg(F.sum(F.col("beta") * F.col("move")).alias("pnl"))


def factor_shock(spark, model: FactorModel, shocks: dict[str, dict[str, float]] = FACTOR_SHOCKS) -> DataFrame:
    return shock(spark, dict(zip(model.names, model.betas)), shocks)


def macro_sensitivities(aligned: AlignedFactors) -> FactorModel:
    """Classical regression of returns on changes of macro drivers."""
    return factor_model(aligned, hac_lags=None)


def worst(results: DataFrame) -> DataFrame:
    return results.agg(F.min_by("scenario", "pnl").alias("scenario"), F.min("pnl").alias("pnl"))
