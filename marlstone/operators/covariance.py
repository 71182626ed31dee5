"""Covariance, correlation and risk: pairwise moments as one distributed aggregation, small matrices in numpy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import numeric
from marlstone.operators import scan
from marlstone.operators.performance import frame


def pairs(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, date, a, b, ra, rb) for the tickers a <= b of each date.

    That is k(k+1)/2 rows a date for k tickers, which aggregations sum up before they shuffle: meant for universes of up to
    some thousand tickers, as the matrices that come from it are."""
    left = returns.select(*by, "date", F.col("ticker").alias("a"), F.col("ret").alias("ra"))
    right = returns.select(*by, "date", F.col("ticker").alias("b"), F.col("ret").alias("rb"))
    return left.join(right, [*by, "date"]).where("a <= b")


def covariance(returns: DataFrame, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """(by…, a, b, cov, n), sample covariance of the upper triangle."""
    return pairs(returns, by).groupBy(*by, "a", "b").agg((F.covar_samp("ra", "rb") * scale).alias("cov"), F.count(F.lit(1)).alias("n"))


def ewma_covariance(returns: DataFrame, decay: float = 0.94, scale: float = 1.0) -> DataFrame:
    """(a, b, cov): zero-mean, weights decaying from the last date, normalised over the dates there are."""
    ranked = pairs(returns).withColumn("__w", F.pow(F.lit(decay), F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("date"))) - 1))
    return ranked.groupBy("a", "b").agg((F.sum(F.col("__w") * F.col("ra") * F.col("rb")) / F.sum("__w") * scale).alias("cov"))


def correlation(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, a, b, rho), Pearson; 1 on the diagonal."""
    return pairs(returns, by).groupBy(*by, "a", "b").agg(F.corr("ra", "rb").alias("__r")).select(*by, "a", "b", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("__r")).alias("rho"))


def average_ranks(returns: DataFrame) -> DataFrame:
    """Returns replaced by their ranks within each ticker; ties share the mean of their places."""
    ordered, same = W.partitionBy("ticker").orderBy("ret"), W.partitionBy("ticker", "ret")
    return returns.withColumn("ret", (F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2).cast("double"))


def spearman(returns: DataFrame) -> DataFrame:
    return correlation(average_ranks(returns))


def correlation_of(cov: DataFrame) -> DataFrame:
    """(a, b, rho) of a covariance table: 0 beside an asset without variance, clipped to [-1, 1], 1 on the diagonal."""
    var = cov.where("a = b").select(F.col("a").alias("t"), F.col("cov").alias("v"))
    joined = cov.join(var.select(F.col("t").alias("a"), F.col("v").alias("va")), "a").join(var.select(F.col("t").alias("b"), F.col("v").alias("vb")), "b")
    rho = F.coalesce(F.try_divide(F.col("cov"), F.sqrt(F.col("va") * F.col("vb"))), F.lit(0.0))
    return joined.select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))


def distance(rho: DataFrame) -> DataFrame:
    """(…, distance): sqrt(2 (1 - rho)), never below 0."""
    return rho.withColumn("distance", F.sqrt(F.greatest(2 * (1 - F.col("rho")), F.lit(0.0))))


def rolling_correlation(returns: DataFrame, window: int = 63) -> DataFrame:
    """(date, a, b, rho) of each full window of each pair a < b."""
    over = frame(["a", "b"], window)
    rows = pairs(returns).where("a < b")
    return rows.withColumns({"rho": F.corr("ra", "rb").over(over), "__n": F.count(F.lit(1)).over(over)}).where(F.col("__n") == window).select("date", "a", "b", "rho")


def average_correlation(returns: DataFrame, window: int = 63) -> DataFrame:
    return rolling_correlation(returns, window).groupBy("date").agg(F.avg("rho").alias("average"), F.min("rho").alias("lowest"), F.max("rho").alias("highest"))


def matrix(table: DataFrame, tickers: Sequence[str], value: str) -> np.ndarray:
    """The symmetric matrix of an upper-triangle table; its size is the number of tickers squared."""
    at = {t: i for i, t in enumerate(tickers)}
    out = np.zeros((len(at), len(at)))
    for r in table.select("a", "b", value).collect():
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r[value]
    return out


@dataclass(frozen=True)
class CovarianceResult:
    """A small covariance matrix with its diagnostics."""

    values: np.ndarray
    tickers: tuple[str, ...]
    method: str = "sample"
    shrinkage: float | None = None
    annualised: bool = False

    def volatilities(self) -> dict[str, float]:
        return dict(zip(self.tickers, np.sqrt(np.maximum(np.diag(self.values), 0))))

    def correlation(self) -> np.ndarray:
        return numeric.correlation_of(self.values)

    def condition_number(self) -> float:
        return float(np.linalg.cond(self.values))

    def smallest_eigenvalue(self) -> float:
        return float(np.linalg.eigvalsh(self.values)[0])

    def is_psd(self, tolerance: float = 1e-10) -> bool:
        return self.smallest_eigenvalue() >= -tolerance

    def table(self, spark):
        rows = [(a, b, float(self.values[i, j])) for i, a in enumerate(self.tickers) for j, b in enumerate(self.tickers)]
        return spark.createDataFrame(rows, "a string, b string, cov double")


def moments(returns: DataFrame) -> DataFrame:
    """(a, b, n, ma, mb, xy, xxyy, xxxy, xyyy): centred moments of every pair, from one self-join."""
    centred = returns.withColumn("ret", F.col("ret") - F.avg("ret").over(W.partitionBy("ticker")))
    x, y = F.col("ra"), F.col("rb")
    return pairs(centred).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x * y).alias("xy"), F.avg(x * x * y * y).alias("xxyy"), F.avg(x * x * x * y).alias("xxxy"), F.avg(x * y * y * y).alias("xyyy")
    )


def estimate(returns: DataFrame, tickers: Sequence[str], method: str = "sample", periods_per_year: int = 252, annualise: bool = False, decay: float = 0.94, ridge: float = 0.0) -> CovarianceResult:
    """The covariance of a few tickers by one of: sample, ewma, ledoit_wolf, constant_correlation."""
    shrinkage = None
    if method == "sample":
        values = matrix(covariance(returns), tickers, "cov")
    elif method == "ewma":
        values = matrix(ewma_covariance(returns, decay), tickers, "cov")
    elif method in ("ledoit_wolf", "constant_correlation"):
        rows = moments(returns).collect()  # one row for each pair of tickers
        values, shrinkage = (numeric.ledoit_wolf if method == "ledoit_wolf" else numeric.constant_correlation)(rows, list(tickers))
    else:
        raise ValueError(f"unknown covariance method {method!r}")
    values = (values + values.T) / 2 + ridge * np.eye(len(values))
    return CovarianceResult(values * (periods_per_year if annualise else 1), tuple(tickers), method, shrinkage, annualise)


def both_triangles(cov: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, a, b, cov) of the whole matrix, from its upper triangle and in one pass over it."""
    sides = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)
    return cov.select(*by, "cov", F.explode(sides).alias("__s")).select(*by, "__s.a", "__s.b", "cov")


def risk_decomposition(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(ticker, weight, marginal, contribution, share) of a book; a book without risk is an error."""
    book = weights.select("ticker", "weight")
    inner = both_triangles(cov).join(book.select(F.col("ticker").alias("b"), F.col("weight").alias("wb")), "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("wb")).alias("sw"))
    rows = inner.join(book, inner["a"] == book["ticker"]).withColumn("__v", F.col("weight") * F.col("sw"))
    rows = rows.withColumn("sigma", F.sqrt(F.sum("__v").over(W.partitionBy(F.lit(1)))))  # one row for each asset of the book
    rows = rows.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.raise_error(F.lit("a book without risk has no decomposition")).cast("double")))
    return rows.select("ticker", "weight", (F.col("sw") / F.col("sigma")).alias("marginal"), (F.col("__v") / F.col("sigma")).alias("contribution"), (F.col("__v") / (F.col("sigma") * F.col("sigma"))).alias("share"), "sigma")


def overweight(decomposition: DataFrame, factor: float = 1.5) -> DataFrame:
    """Assets whose share of risk is more than ``factor`` times their weight."""
    return decomposition.where(F.col("share") > factor * F.col("weight"))


def rolling_risk_contribution(returns: DataFrame, weights: dict[str, float], window: int = 63, decay: float | None = 0.94) -> DataFrame:
    """(date, ticker, share, reason): each full window's risk shares; ``reason`` says why a window has none.

    The windows' cross-products come from frames over each pair; each date's small matrix is one group."""
    tickers = sorted(weights)
    rows = pairs(returns.where(F.col("ticker").isin(tickers)))
    if decay is None:
        over = frame(["a", "b"], window)
        cov = rows.withColumns({"cov": F.covar_samp("ra", "rb").over(over), "__n": F.count(F.lit(1)).over(over)}).where(F.col("__n") == window).select("date", "a", "b", "cov")
    else:
        cov = scan.sliding_ewma(rows, F.col("ra") * F.col("rb"), window, decay, ["a", "b"], name="cov").select("date", "a", "b", "cov")
    book = returns.sparkSession.createDataFrame([(t, float(w)) for t, w in weights.items()], "t string, w double")
    rc = both_triangles(cov, ["date"]).join(book.select(F.col("t").alias("b"), F.col("w").alias("wb")), "b").groupBy("date", "a").agg(F.sum(F.col("cov") * F.col("wb")).alias("sw"))
    rc = rc.join(book.select(F.col("t").alias("a"), F.col("w").alias("wa")), "a").withColumn("rc", F.col("wa") * F.col("sw"))
    total = F.sum("rc").over(W.partitionBy("date"))
    return rc.select("date", F.col("a").alias("ticker"), F.try_divide(F.col("rc"), total).alias("share"), F.when(total <= 0, F.lit("no variance in the window")).alias("reason"))


def historical_tail(returns: DataFrame, by: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """(by…, n, var_hist, cvar_hist, var_gauss, var_cf): tail measures of each track, Cornish-Fisher by biased moments."""
    z = numeric.normal_quantile(1 - confidence)
    tracks = returns.withColumn("__q", F.percentile("ret", F.lit(1 - confidence)).over(W.partitionBy(*by)))  # one shuffle for both steps
    sums = tracks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"), F.skewness("ret").alias("__sk"), F.kurtosis("ret").alias("__ku"),
        (-F.first("__q")).alias("var_hist"), (-F.avg(F.when(F.col("ret") <= F.col("__q"), F.col("ret")))).alias("__t"),
    )
    sk, ku = F.col("__sk"), F.col("__ku")
    cf = z + (z * z - 1) / 6 * sk + (z**3 - 3 * z) / 24 * ku - (2 * z**3 - 5 * z) / 36 * sk * sk
    return sums.select(
        *by, "n", "var_hist", F.coalesce("__t", "var_hist").alias("cvar_hist"), (-(F.col("__m") + z * F.col("__s"))).alias("var_gauss"), (-(F.col("__m") + cf * F.col("__s"))).alias("var_cf")
    )


def tail_comparison(returns: DataFrame, by: Sequence[str], confidence: float = 0.99, threshold: float = 0.95) -> DataFrame:
    """(by…, n, var_hist, cvar_hist, var_gauss, var_cf, shape, var_evt, cvar_evt, reason): all tail measures side by side."""
    evt = evt_tail(returns, by, confidence, threshold).select(*by, "shape", "var_evt", "cvar_evt", "reason")
    return historical_tail(returns, by, confidence).join(evt, list(by), "left")


def ewma_correlation(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    """(a, b, rho) of the exponentially weighted covariance."""
    return correlation_of(ewma_covariance(returns, decay))


def exceedances(returns: DataFrame, by: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """(by…, loss, threshold, n, position): the losses above each track's threshold quantile, with the track's rows and the
    plotting position (rank - 1/2) / count among them."""
    track = W.partitionBy(*by)
    losses = returns.select(*by, (-F.col("ret")).alias("loss"))
    losses = losses.withColumns({"threshold": F.percentile("loss", F.lit(threshold)).over(track), "n": F.count(F.lit(1)).over(track)})
    over = losses.where("loss > threshold")
    return over.withColumn("position", (F.row_number().over(track.orderBy("loss")) - 0.5) / F.count(F.lit(1)).over(track))


def exposures(rows: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """(by…, effective_n, gross, net) of each book of weights; 0 effective positions without any weight."""
    w = F.col(weight)
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.lit(1.0), F.sum(w * w)), F.lit(0.0)).alias("effective_n"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"))


def evt_tail(returns: DataFrame, by: Sequence[str], confidence: float = 0.99, threshold: float = 0.95) -> DataFrame:
    """(by…, threshold, n, exceedances, shape, scale, var_evt, cvar_evt, reason): a generalised Pareto tail of each track.

    Only the losses above each track's threshold quantile go to the fit, one group for each track. Fewer than 10 give a
    reason and no numbers; a shape of 1 or more has no finite CVaR.
    """
    over = exceedances(returns, by, threshold).drop("position")
    schema = ", ".join([*(f"{c} {returns.schema[c].dataType.simpleString()}" for c in by), "threshold double, n long, exceedances long, shape double, scale double, var_evt double, cvar_evt double, reason string"])

    def fit(key, pdf):
        import pandas as pd

        head = {c: [k] for c, k in zip(by, key)}
        return pd.DataFrame({**head, **{k: [v] for k, v in numeric.pot_tail(pdf["loss"].to_numpy() - pdf["threshold"].iloc[0], float(pdf["threshold"].iloc[0]), int(pdf["n"].iloc[0]), confidence).items()}})

    return over.groupBy(*by).applyInPandas(fit, schema)
