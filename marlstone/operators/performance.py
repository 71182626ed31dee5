"""Performance: the metric set as one aggregation, drawdowns, and rolling measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.operators import scan
from marlstone.staging import staged


def growth(returns: DataFrame, by: Sequence[str] = (), ret: str = "ret") -> DataFrame:
    """Add ``growth`` (cumulated product of 1 + r), ``peak`` and ``drawdown`` by date within ``by``.

    Without ``by`` the whole series is one group, as a single track of daily returns is."""
    keys = list(by) or [F.lit(1)]
    run = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = returns.withColumn("growth", F.product(1 + F.col(ret)).over(run))
    rows = rows.withColumn("peak", F.max("growth").over(run))
    return rows.withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def log_drawdown(returns: DataFrame, by: Sequence[str] = (), ret: str = "ret") -> DataFrame:
    """Drawdowns from sums of logarithms, for long series whose product would overflow."""
    keys = list(by) or [F.lit(1)]
    run = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = returns.withColumn("__l", F.sum(F.log1p(ret)).over(run))
    return rows.withColumn("drawdown", F.exp(F.col("__l") - F.max("__l").over(run)) - 1).drop("__l")


def runs(rows: DataFrame, flag: Column, by: Sequence[str], order: str = "date") -> DataFrame:
    """Lengths of runs of rows in a row for which ``flag`` holds: (by…, run, length, first, last)."""
    window = W.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("__f", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("run", F.sum((~F.col("__f")).cast("long")).over(window))
    return marked.where("__f").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("first"), F.max(order).alias("last"))


def drawdown_duration(drawdowns: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, duration): the longest run of rows below the peak; 0 for tracks without any."""
    longest = runs(drawdowns, F.col("drawdown") < 0, by).groupBy(*by).agg(F.max("length").alias("d"))
    return drawdowns.select(*by).distinct().join(longest, list(by), "left").select(*by, F.coalesce("d", F.lit(0)).alias("duration"))


def zero_if(condition: Column, value: Column) -> Column:
    return F.when(condition, F.lit(0.0)).otherwise(value)


def metrics(returns: DataFrame, by: Sequence[str], periods_per_year: int = 252, rate: float = 0.04, confidence: float = 0.95, ret: str = "ret", span_days: float | None = None) -> DataFrame:
    """The metric set of each track, from one shuffle by track: windows in the order of dates give drawdowns, the length of the
    drawdown so far and the track's quantile, and one aggregation over the same partitions gives the rest.

    With ``span_days`` tracks may be of any length: drawdowns are a prefix scan over spans of so many days and the quantile is
    selected from a bracket, so that no task holds a track. Ratios are 0 where their denominator is 0. A null or NaN return doesn't count. CVaR is VaR where no return reaches it.
    """
    by = list(by)
    root = math.sqrt(periods_per_year)
    clean = returns.where(F.col(ret).isNotNull() & ~F.isnan(ret)).select(*by, "date", F.col(ret).alias("ret"))
    if span_days is not None:
        clean = staged(clean, "returns")  # read by the scan and by each round of the selection
        quantiles = scan.exact_quantiles(clean, by, "ret", 1 - confidence).select(*by, F.col("quantile").alias("__q"))
        tracks = scan.growth_scan(clean, by, days=span_days).withColumnRenamed("below", "__below").join(quantiles, by)
    else:
        run = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
        tracks = growth(clean, by).withColumn("__i", F.count(F.lit(1)).over(run))
        tracks = tracks.withColumn("__below", F.col("__i") - F.coalesce(F.last(F.when(F.col("drawdown") >= 0, F.col("__i")), ignorenulls=True).over(run), F.lit(0)))
        tracks = tracks.withColumn("__q", F.percentile("ret", F.lit(1 - confidence)).over(W.partitionBy(*by)))
    ex = F.col("ret") - rate / periods_per_year
    sums = tracks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        (F.product(1 + F.col("ret")) - 1).alias("total_return"),
        F.avg(ex).alias("__mean"),
        F.stddev_samp("ret").alias("__sd"),
        F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2))).alias("__down"),
        F.sqrt(F.avg(F.pow(F.least(ex, F.lit(0.0)), 2))).alias("__down_excess"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("__below").alias("max_drawdown_duration"),
        (-F.first("__q")).alias("var_hist"),
        (-F.avg(F.when(F.col("ret") <= F.col("__q"), F.col("ret")))).alias("cvar_hist"),
        F.skewness("ret").alias("skewness"),
        F.kurtosis("ret").alias("kurtosis"),
        F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"),
        F.max("ret").alias("best"),
        F.min("ret").alias("worst"),
    )
    sums = sums.withColumns(
        {
            "cagr": F.pow(1 + F.col("total_return"), F.lit(periods_per_year) / F.col("n_obs")) - 1,
            "volatility": F.coalesce(F.col("__sd"), F.lit(0.0)) * root,
            "downside_deviation": F.col("__down") * root,
            "sharpe": zero_if(F.coalesce(F.col("__sd"), F.lit(0.0)) == 0, F.try_divide(F.col("__mean"), F.col("__sd")) * root),
            "sortino": zero_if(F.col("__down_excess") == 0, F.try_divide(F.col("__mean"), F.col("__down_excess")) * root),
        }
    ).withColumn("calmar", zero_if(F.col("max_drawdown") == 0, F.try_divide(F.col("cagr"), F.abs("max_drawdown"))))
    return sums.withColumn("cvar_hist", F.coalesce("cvar_hist", "var_hist")).drop("__mean", "__sd", "__down", "__down_excess")


def frame(by: Sequence[str], window: int):
    keys = list(by) or [F.lit(1)]
    return W.partitionBy(*keys).orderBy("date").rowsBetween(1 - window, 0)


def rolling(returns: DataFrame, measures: dict[str, "callable"], window: int, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rolling measures stamped at each full window's last date. ``measures``: name -> function of the window frame."""
    over = frame(by, window)
    rows = returns.withColumns({"__n": F.count(F.lit(1)).over(over), **{k: f(over) for k, f in measures.items()}})
    return rows.where(F.col("__n") == window).drop("__n")


def rolling_volatility(returns: DataFrame, window: int = 63, periods_per_year: int = 252, by: Sequence[str] = ("ticker",)) -> DataFrame:
    return rolling(returns, {"volatility": lambda w: F.stddev_samp("ret").over(w) * math.sqrt(periods_per_year)}, window, by)


def rolling_sharpe(returns: DataFrame, window: int = 252, periods_per_year: int = 252, rate: float = 0.04, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Null where a window has no variance."""
    mean = lambda w: F.avg(F.col("ret") - rate / periods_per_year).over(w)
    return rolling(returns, {"sharpe": lambda w: F.try_divide(mean(w), F.stddev_samp("ret").over(w)) * math.sqrt(periods_per_year)}, window, by)


def rolling_drawdown(returns: DataFrame, window: int = 252, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """The largest drawdown within each full window, whose peak starts anew with the window; each row costs the same whatever
    the window's width."""
    return scan.sliding_drawdown(returns, window, by)


def segment_rebased(equity: DataFrame, segment: str) -> DataFrame:
    """Equity over its segment's first value."""
    return equity.withColumn("equity", F.col("equity") / F.first("equity").over(W.partitionBy(segment).orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
