"""Factor models: alignment, regression by sums of products, attribution, rolling betas, principal components."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import numeric
from marlstone.functions.calendar import Calendar, require_trading_days
from marlstone.operators.performance import frame

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class AlignedFactors:
    """Returns and factors on the dates that both have: columns date, ret and one for each factor."""

    data: DataFrame
    factors: tuple[str, ...]
    dropped: int

    def coverage(self) -> str:
        first, last, n = self.data.agg(F.min("date"), F.max("date"), F.count(F.lit(1))).head()
        return f"{n} rows from {first} to {last}, {self.dropped} without factors"


def align(returns: DataFrame, factors: DataFrame, names: Sequence[str], calendar: Calendar = Calendar.TRADING_DAYS) -> AlignedFactors:
    """Inner join by date of (date, ret) and a wide factor table; rows with a null are dropped and the loss is reported."""
    require_trading_days(calendar, "the factor engine")
    missing = [n for n in names if n not in factors.columns]
    if missing:
        raise KeyError(f"unknown factors {missing}")
    data = returns.select("date", "ret").join(factors.select("date", *names), "date").dropna()
    before, after = returns.count(), data.count()
    if not after:
        raise ValueError("returns and factors share no date")
    if after < before:
        log.warning("%d of %d return dates have no factors", before - after, before)
    return AlignedFactors(data, tuple(names), before - after)


@dataclass(frozen=True)
class FactorModel:
    names: tuple[str, ...]
    alpha: float
    betas: np.ndarray
    std_errors: np.ndarray
    t_stats: np.ndarray
    p_values: np.ndarray
    r_squared: float
    adj_r_squared: float
    n_obs: int
    residual_sd: float
    periods_per_year: int

    @property
    def annual_alpha(self) -> float:
        return self.alpha * self.periods_per_year

    @property
    def annual_idiosyncratic(self) -> float:
        return self.residual_sd * math.sqrt(self.periods_per_year)

    def table(self, spark) -> DataFrame:
        rows = [(n, float(b), float(s), float(t), float(p)) for n, b, s, t, p in zip(("alpha", *self.names), (self.alpha, *self.betas), self.std_errors, self.t_stats, self.p_values)]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_stat double, p_value double")


def _sums(data: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The matrix of sums of products of the columns and a constant, in one aggregation."""
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    k = len(terms)
    row = data.agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).head()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def with_residuals(data: DataFrame, names: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    fitted = sum((F.col(n) * float(b) for n, b in zip(names, coefficients[1:])), F.lit(float(coefficients[0])))
    return data.withColumn("fitted", fitted).withColumn("residual", F.col("ret") - F.col("fitted"))


def factor_model(aligned: AlignedFactors, hac_lags: int | None = 5, periods_per_year: int = 252) -> FactorModel:
    """Least squares by sums of products; Newey-West errors with Bartlett weights and normal p-values, or classical ones."""
    names = list(aligned.factors)
    sums = _sums(aligned.data, [*names, "ret"])
    xtx, xty, yty, n, k = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1], int(sums[0, 0]), len(names) + 1
    b = numeric.ols(xtx, xty)
    sse = max(float(yty - b @ xty), 0.0)
    sst = float(yty - sums[0, -1] ** 2 / n)
    inverse = np.linalg.pinv(xtx)
    if hac_lags is None:
        cov = inverse * sse / max(1, n - k)
    else:
        rows = with_residuals(aligned.data, names, b)
        track = W.partitionBy(F.lit(1)).orderBy("date")  # one track of dates
        terms = [F.lit(1.0), *[F.col(c) for c in names]]
        scores = rows.select("date", *[(F.col("residual") * t).alias(f"g{i}") for i, t in enumerate(terms)])
        scores = scores.select("*", *[F.lag(f"g{i}", lag).over(track).alias(f"g{i}_{lag}") for lag in range(1, hac_lags + 1) for i in range(k)])
        cols = [F.sum(F.col(f"g{i}") * F.col(f"g{j}" if not lag else f"g{j}_{lag}")).alias(f"m{lag}_{i}_{j}") for lag in range(hac_lags + 1) for i in range(k) for j in range(k)]
        row = scores.agg(*cols).head()
        meat = np.zeros((k, k))
        for lag in range(hac_lags + 1):
            part = np.array([[row[f"m{lag}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
            meat += part if not lag else (1 - lag / (hac_lags + 1)) * (part + part.T)
        cov = inverse @ meat @ inverse
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    t = np.divide(b, se, out=np.full(k, np.nan), where=se > 0)
    p = [numeric.student_two_sided(x, n - k) if hac_lags is None else numeric.normal_two_sided(x) for x in t]
    r2 = 1 - sse / sst if sst > 0 else 0.0
    return FactorModel(tuple(names), float(b[0]), b[1:], se, t, np.array(p), r2, 1 - (1 - r2) * (n - 1) / max(1, n - k), n, math.sqrt(sse / max(1, n - k)), periods_per_year)


def factor_covariance(aligned: AlignedFactors, periods_per_year: int = 252) -> np.ndarray:
    names = list(aligned.factors)
    s = _sums(aligned.data, names)
    n = s[0, 0]
    mean = s[0, 1:] / n
    return (s[1:, 1:] - n * np.outer(mean, mean)) / (n - 1) * periods_per_year


def factor_risk(model: FactorModel, cov: np.ndarray) -> dict:
    """Systematic, specific and total variance, and each factor's share of the total."""
    systematic = float(model.betas @ cov @ model.betas)
    specific = model.annual_idiosyncratic**2
    total = systematic + specific
    shares = model.betas * (cov @ model.betas) / total if total > 0 else np.zeros(len(model.betas))
    return {"systematic": systematic, "specific": specific, "total": total, "volatility": math.sqrt(total), "shares": dict(zip(model.names, map(float, shares)))}


def attribution(aligned: AlignedFactors, model: FactorModel) -> dict:
    """Mean return split into alpha and factor parts, and what the parts miss."""
    row = aligned.data.agg(F.avg("ret").alias("__ret"), *[F.avg(n).alias(n) for n in aligned.factors]).head()
    parts = {n: float(b * row[n]) for n, b in zip(model.names, model.betas)}
    return {"alpha": model.alpha, "factors": parts, "mean": row["__ret"], "error": row["__ret"] - model.alpha - sum(parts.values())}


def implied_covariance(loadings: np.ndarray, factor_cov: np.ndarray, residual_sd: np.ndarray) -> np.ndarray:
    """B F B' + D."""
    if loadings.shape[1] != factor_cov.shape[0] or loadings.shape[0] != len(residual_sd):
        raise ValueError("loadings, factor covariance and residuals don't match")
    return loadings @ factor_cov @ loadings.T + np.diag(np.asarray(residual_sd) ** 2)


def estimate_implied_covariance(returns: DataFrame, factors: DataFrame, tickers: Sequence[str], names: Sequence[str], periods_per_year: int = 252) -> np.ndarray:
    """B F B' + D of long returns (date, ticker, ret) and a wide factor table: every ticker's regression comes from one
    aggregation of sums of products, of the size of the factors for each ticker. D has T - K - 1 degrees of freedom."""
    k = len(names) + 1
    terms = [F.lit(1.0), *[F.col(n) for n in names], F.col("ret")]
    data = returns.where(F.col("ticker").isin(list(tickers))).join(factors.select("date", *names), "date").dropna()
    rows = {r["ticker"]: r for r in data.groupBy("ticker").agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).collect()}  # one row for each ticker
    loadings, residual = np.zeros((len(tickers), k - 1)), np.zeros(len(tickers))
    for at, t in enumerate(tickers):
        s = np.array([[rows[t][f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        b = numeric.ols(s[:k, :k], s[:k, k])
        loadings[at] = b[1:]
        residual[at] = math.sqrt(max(s[k, k] - b @ s[:k, k], 0.0) / max(1, s[0, 0] - k))
    n = s[0, 0]
    mean = s[0, 1:k] / n
    return implied_covariance(loadings, (s[1:k, 1:k] - n * np.outer(mean, mean)) / (n - 1), residual) * periods_per_year


def rolling_beta(pairs: DataFrame, window: int = 252, by: Sequence[str] = ()) -> DataFrame:
    """(by…, date, alpha, beta, r_squared) of ret on one factor column ``factor``, over each full window."""
    over = frame(by, window)
    rows = pairs.withColumns({"beta": F.regr_slope("ret", "factor").over(over), "alpha": F.regr_intercept("ret", "factor").over(over), "r_squared": F.regr_r2("ret", "factor").over(over), "__n": F.count(F.lit(1)).over(over)})
    return rows.where(F.col("__n") == window).select(*by, "date", "alpha", "beta", "r_squared")


def rolling_betas(aligned: AlignedFactors, window: int = 252) -> DataFrame:
    """(date, alpha, one column for each factor, r_squared): frame sums of products, solved in vectorised batches."""
    names = list(aligned.factors)
    over = frame((), window)
    terms = {"__1": F.lit(1.0), **{n: F.col(n) for n in names}, "__y": F.col("ret")}
    keys = list(terms)
    sums = {f"s{i}_{j}": F.sum(terms[a] * terms[b]).over(over) for i, a in enumerate(keys) for j, b in enumerate(keys) if i <= j}
    rows = aligned.data.withColumns({**sums, "__n": F.count(F.lit(1)).over(over)}).where(F.col("__n") == window).select("date", *sums)
    k = len(names) + 1
    schema = "date date, alpha double, " + ", ".join(f"`{n}` double" for n in names) + ", r_squared double"

    def solve(batches):
        for pdf in batches:
            s = np.zeros((len(pdf), k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    s[:, i, j] = s[:, j, i] = pdf[f"s{i}_{j}"]
            b = np.linalg.solve(s[:, :k, :k] + 1e-14 * np.eye(k), s[:, :k, k][:, :, None])[:, :, 0]
            sst = s[:, k, k] - s[:, 0, k] ** 2 / window
            sse = s[:, k, k] - (b * s[:, :k, k]).sum(axis=1)
            out = pdf[["date"]].copy()
            out["alpha"] = b[:, 0]
            for i, n in enumerate(names):
                out[n] = b[:, i + 1]
            out["r_squared"] = np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), 0.0)
            yield out

    return rows.mapInPandas(solve, schema)


@dataclass(frozen=True)
class PrincipalComponents:
    tickers: tuple[str, ...]
    values: np.ndarray
    loadings: np.ndarray
    method: str

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.values.sum() if self.values.sum() > 0 else self.values

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.explained)

    def n_factors_for(self, share: float) -> int:
        return int(min(np.searchsorted(self.cumulative, share - 1e-12) + 1, len(self.values)))

    def volatilities(self) -> np.ndarray:
        return np.sqrt(self.values)

    def portfolio(self, k: int, normalise: str = "unit") -> dict[str, float]:
        """The k-th component as a book, of unit length or of weights that sum to 1."""
        w = self.loadings[:, k]
        return dict(zip(self.tickers, w / w.sum() if normalise == "sum" and abs(w.sum()) > 1e-12 else w))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(t, k + 1, float(self.loadings[i, k])) for i, t in enumerate(self.tickers) for k in range(len(self.values))], "ticker string, component int, loading double")


def principal_components(cov: np.ndarray, tickers: Sequence[str], method: str = "covariance") -> PrincipalComponents:
    """Eigenvectors by descending eigenvalue, each turned so that its largest loading is positive."""
    if method not in ("covariance", "correlation"):
        raise ValueError(f"unknown method {method!r}")
    values, vectors = np.linalg.eigh(numeric.correlation_of(cov) if method == "correlation" else cov)
    return PrincipalComponents(tuple(tickers), np.maximum(values[::-1], 0), numeric.sign_fixed(vectors[:, ::-1]), method)


def scores(returns: DataFrame, pca: PrincipalComponents) -> DataFrame:
    """(date, component, score) of centred returns."""
    centred = returns.withColumn("ret", F.col("ret") - F.avg("ret").over(W.partitionBy("ticker")))
    return centred.join(pca.table(returns.sparkSession), "ticker").groupBy("date", "component").agg(F.sum(F.col("ret") * F.col("loading")).alias("score"))


def concentration(weights: dict[str, float], cov: np.ndarray, tickers: Sequence[str]) -> dict:
    """Effective bets by risk (entropy of the components' shares of variance) against effective positions by weight."""
    w = np.array([weights.get(t, 0.0) for t in tickers])
    pca = principal_components(cov, tickers)
    share = pca.values * (pca.loadings.T @ w) ** 2
    total = share.sum()
    share = share / total if total > 0 else np.full(len(share), 1 / len(share))
    positive = share[share > 1e-15]
    bets = float(np.exp(-(positive * np.log(positive)).sum()))
    positions = 1 / float((w**2).sum()) if (w**2).sum() > 0 else 0.0
    ratio = bets / positions if positions else 0.0
    verdict = "HIGH" if ratio < 0.5 else "MODERATE" if ratio < 0.75 else "LOW"
    return {"effective_bets": bets, "effective_positions": positions, "gap": positions - bets, "top_share": float(share.max()), "ratio": ratio, "verdict": verdict, "shares": share}
