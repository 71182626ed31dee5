"""All registered queries of the core library with their DuckDB twins."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import numeric, optimizers
from marlstone.operators import covariance as C
from marlstone.operators import factors as FA
from marlstone.operators import networks, panel, performance, regimes, scan, stress
from marlstone.operators import wide as WI
from marlstone.plans import backtest, panels, quality, strategies, walkforward
from marlstone.session import read_table
from marlstone.staging import scratch_dir, staged
from marlstone.sources import datasource, parsers
from marlstone.sources.store import scratch_store, table_function
from marlstone.streaming import twins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FLAG_BOOK = {"A": 0.5, "N": 0.3, "R": 0.2}
Z05 = numeric.normal_quantile(0.05)
ROOT = math.sqrt(252)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as the order of a sum moves its last digits; integers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, places) if kind == "double" else c.cast("long") if kind in ("integer", "short", "byte") else c).alias(f.name))
    return df.select(*out)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------- panels and returns


@query(panels.sql("flagstat", select="SELECT date, ticker, round(price, 6) AS price FROM a"))
def panel_intersection(spark, d):
    return rounded(panels.aligned(spark, d, "flagstat").select("date", "ticker", "price"))


@query(panels.sql("flag", select="SELECT date, ticker, round(ret, 6) AS ret FROM r"))
def simple_returns(spark, d):
    return rounded(panels.returns(spark, d, "flag"))


@query(panels.sql("flag", select="SELECT date, ticker, round(ln(price / prev), 6) AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM a) WHERE prev IS NOT NULL"))
def log_returns(spark, d):
    return rounded(panel.log_returns(panels.aligned(spark, d, "flag")))


_BOOK = "book AS (SELECT * FROM (VALUES ('A', 0.5), ('N', 0.3), ('R', 0.2)) t(ticker, weight))"
_PORT = "port AS (SELECT date, sum(weight * ret) AS ret FROM r JOIN book USING (ticker) GROUP BY date)"


@query(panels.sql("flag", _BOOK, _PORT, select="SELECT date, round(ret, 6) AS ret FROM port"))
def portfolio_returns(spark, d):
    return rounded(panel.portfolio_returns(panels.returns(spark, d, "flag"), FLAG_BOOK))


@query(panels.sql("flag", select="SELECT date, ticker, round(ret - 0.04 / 252, 6) AS excess FROM r"))
def excess_returns(spark, d):
    return rounded(panel.excess(panels.returns(spark, d, "flag"), 252).select("date", "ticker", "excess"))


def _metrics_sql(name: str, key: str, source: str) -> str:
    return panels.sql(
        name,
        f"s AS (SELECT {key} AS k, date, ret FROM {source})",
        "g AS (SELECT *, product(1 + ret) OVER (PARTITION BY k ORDER BY date) AS growth FROM s)",
        "dd AS (SELECT *, growth / max(growth) OVER (PARTITION BY k ORDER BY date) - 1 AS dd FROM g)",
        "f AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY date) AS run FROM dd)",
        "dur AS (SELECT k, max(n) AS duration FROM (SELECT k, run, count(*) FILTER (WHERE dd < 0) AS n FROM f GROUP BY 1, 2) GROUP BY k)",
        "v AS (SELECT k, -quantile_cont(ret, 0.05) AS var FROM s GROUP BY k)",
        "t AS (SELECT k, avg(ret) FILTER (WHERE ret <= -var) AS tail FROM s JOIN v USING (k) GROUP BY k)",
        """m AS (SELECT k, count(*) AS n_obs, min(date) AS first, max(date) AS last, product(1 + ret) - 1 AS total_return, avg(ret - 0.04 / 252) AS mean, stddev_samp(ret) AS sd,
            sqrt(avg(pow(least(ret, 0), 2))) AS down, sqrt(avg(pow(least(ret - 0.04 / 252, 0), 2))) AS downx, min(dd) AS mdd,
            avg(pow(ret, 3)) AS m3, avg(pow(ret, 2)) AS m2, avg(ret) AS m1, kurtosis_pop(ret) AS kurt, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit, max(ret) AS best, min(ret) AS worst
            FROM dd GROUP BY k)""",
        select="""SELECT k AS ticker, n_obs, first, last, round(total_return, 6) AS total_return, round(pow(1 + total_return, 252.0 / n_obs) - 1, 6) AS cagr, round(sd * sqrt(252), 6) AS volatility,
            round(down * sqrt(252), 6) AS downside_deviation, round(mean / sd * sqrt(252), 6) AS sharpe, round(mean / downx * sqrt(252), 6) AS sortino, round(mdd, 6) AS max_drawdown, duration AS max_drawdown_duration,
            round(CASE WHEN mdd = 0 THEN 0 ELSE (pow(1 + total_return, 252.0 / n_obs) - 1) / abs(mdd) END, 6) AS calmar, round(var, 6) AS var_hist, round(coalesce(-tail, var), 6) AS cvar_hist,
            round((m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(m2 - m1 * m1, 1.5), 6) AS skewness, round(kurt, 6) AS kurtosis, round(hit, 6) AS hit_rate, round(best, 6) AS best, round(worst, 6) AS worst
            FROM m JOIN dur USING (k) JOIN v USING (k) JOIN t USING (k)""",
    )


def _metrics(rows: DataFrame, span_days: float | None = None) -> DataFrame:
    out = performance.metrics(rows, ["ticker"], span_days=span_days).withColumnsRenamed({"start": "first", "end": "last"})
    return rounded(out)


@query(_metrics_sql("flag", "ticker", "r"))
def perf_metrics(spark, d):
    return _metrics(panels.returns(spark, d, "flag"))


@query(_metrics_sql("event_day", "'book'", "(SELECT date, avg(ret) AS ret FROM r GROUP BY date)"))
def perf_metrics_events(spark, d):
    """One track, by spans of time: no task holds it."""
    return _metrics(panel.equal_weight_returns(panels.returns(spark, d, "event_day")).withColumn("ticker", F.lit("book")), scan.SPAN_DAYS)


@query(_metrics_sql("flag", "ticker", "r"))
def perf_metrics_spans(spark, d):
    """The same measures as ``perf_metrics``, each track in many spans and its quantile selected from a bracket."""
    return _metrics(panels.returns(spark, d, "flag"), 180)


@query(panels.sql("flag", "q AS (SELECT ticker, count(*) AS n, quantile_cont(ret, 0.5) AS median, quantile_cont(ret, 0.99) AS high FROM r GROUP BY ticker)", select="SELECT ticker, n, round(median, 9) AS median, round(high, 9) AS high FROM q"))
def selected_quantiles(spark, d):
    rows = staged(panels.returns(spark, d, "flag"), "returns")
    high = scan.exact_quantiles(rows, ["ticker"], "ret", 0.99, most=200).select("ticker", F.col("quantile").alias("high"))
    return rounded(scan.exact_quantiles(rows, ["ticker"], "ret", 0.5, most=200).withColumnRenamed("quantile", "median").join(high, "ticker"), 9)


_GROWTH = "g AS (SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS growth FROM r)"
_DD = "dd AS (SELECT *, growth / max(growth) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM g)"


@query(panels.sql("flag", _GROWTH, _DD, select="SELECT date, ticker, round(drawdown, 9) AS drawdown FROM dd"))
def drawdown(spark, d):
    return rounded(performance.growth(panels.returns(spark, d, "flag"), ["ticker"]).select("date", "ticker", "drawdown"), 9)


@query(panels.sql("flag", _GROWTH, _DD, select="SELECT date, ticker, round(drawdown, 9) AS drawdown FROM dd"))
def drawdown_by_logs(spark, d):
    return rounded(performance.log_drawdown(panels.returns(spark, d, "flag"), ["ticker"]).select("date", "ticker", "drawdown"), 9)


@query(
    panels.sql(
        "flag", _GROWTH, _DD,
        "f AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS run FROM dd)",
        select="SELECT ticker, max(n) AS duration FROM (SELECT ticker, run, count(*) FILTER (WHERE drawdown < 0) AS n FROM f GROUP BY 1, 2) GROUP BY ticker",
    )
)
def drawdown_duration(spark, d):
    return performance.drawdown_duration(performance.growth(panels.returns(spark, d, "flag"), ["ticker"]), ["ticker"])


def _roll_sql(expr: str, window: int, name: str = "flag") -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return panels.sql(name, select=f"SELECT date, ticker, round(v, 6) AS value FROM (SELECT date, ticker, {expr.replace('OVER', over)} AS v, count(*) {over} AS n FROM r) WHERE n = {window}")


@query(_roll_sql("stddev_samp(ret) OVER * sqrt(252)", 63))
def rolling_volatility(spark, d):
    return rounded(performance.rolling_volatility(panels.returns(spark, d, "flag")).select("date", "ticker", F.col("volatility").alias("value")))


@query(_roll_sql("avg(ret - 0.04 / 252) OVER / stddev_samp(ret) OVER * sqrt(252)", 252))
def rolling_sharpe(spark, d):
    return rounded(performance.rolling_sharpe(panels.returns(spark, d, "flag")).select("date", "ticker", F.col("sharpe").alias("value")))


@query(
    panels.sql(
        "prio_month",
        "n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS g FROM r)",
        select="SELECT e.date, e.ticker, round(min(j.g / i.g - 1), 6) AS value FROM n e JOIN n i ON i.ticker = e.ticker AND i.i BETWEEN e.i - 11 AND e.i JOIN n j ON j.ticker = e.ticker AND j.i BETWEEN i.i AND e.i WHERE e.i >= 12 GROUP BY 1, 2",
    )
)
def rolling_drawdown(spark, d):
    return rounded(performance.rolling_drawdown(panels.returns(spark, d, "prio_month"), 12).select("date", "ticker", F.col("max_drawdown").alias("value")))


@query(
    panels.sql(
        "flag",
        "n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS g FROM r)",
        "pk AS (SELECT e.ticker, e.i, j.i AS at, j.g, max(j.g) OVER (PARTITION BY e.ticker, e.i ORDER BY j.i) AS peak FROM n e JOIN n j ON j.ticker = e.ticker AND j.i BETWEEN e.i - 251 AND e.i WHERE e.i >= 252)",
        "wd AS (SELECT ticker, i, min(g / peak - 1) AS v FROM pk GROUP BY 1, 2)",
        select="SELECT date, ticker, round(v, 6) AS value FROM wd JOIN n USING (ticker, i)",
    )
)
def rolling_drawdown_year(spark, d):
    return rounded(performance.rolling_drawdown(panels.returns(spark, d, "flag"), 252).select("date", "ticker", F.col("max_drawdown").alias("value")))


# ---------------------------------------------------------------- covariance and risk

_PAIRS = "pr AS (SELECT x.date, x.ticker AS a, y.ticker AS b, x.ret AS ra, y.ret AS rb FROM r x JOIN r y ON x.date = y.date AND x.ticker <= y.ticker)"
_COV = "cv AS (SELECT a, b, covar_samp(ra, rb) AS cov, count(*) AS n FROM pr GROUP BY 1, 2)"


@query(panels.sql("prio_month", _PAIRS, _COV, select="SELECT a, b, round(cov, 14) AS cov, n FROM cv"))
def cov_matrix(spark, d):
    return rounded(C.covariance(panels.returns(spark, d, "prio_month")), 14)


@query(
    panels.sql(
        "prio_month", _PAIRS, "w AS (SELECT *, pow(0.94, row_number() OVER (PARTITION BY a, b ORDER BY date DESC) - 1) AS w FROM pr)",
        select="SELECT a, b, round(sum(w * ra * rb) / sum(w), 14) AS cov FROM w GROUP BY 1, 2",
    )
)
def ewma_cov(spark, d):
    return rounded(C.ewma_covariance(panels.returns(spark, d, "prio_month")), 14)


@query(
    panels.sql(
        "prio_month", _PAIRS, "w AS (SELECT *, pow(0.94, row_number() OVER (PARTITION BY a, b ORDER BY date DESC) - 1) AS w FROM pr)", "ew AS (SELECT a, b, sum(w * ra * rb) / sum(w) AS cov FROM w GROUP BY 1, 2)",
        select="SELECT c.a, c.b, round(CASE WHEN c.a = c.b THEN 1.0 ELSE c.cov / sqrt(x.cov * y.cov) END, 6) AS rho FROM ew c JOIN ew x ON x.a = c.a AND x.b = c.a JOIN ew y ON y.a = c.b AND y.b = c.b",
    )
)
def ewma_corr(spark, d):
    return rounded(C.ewma_correlation(panels.returns(spark, d, "prio_month")))


_RHO = "rho AS (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE corr(ra, rb) END AS rho FROM pr GROUP BY 1, 2)"


@query(panels.sql("prio_month", _PAIRS, _RHO, select="SELECT a, b, round(rho, 6) AS rho FROM rho"))
def corr_matrix(spark, d):
    return rounded(C.correlation(panels.returns(spark, d, "prio_month")))


@query(
    panels.sql(
        "prio_month", "k AS (SELECT date, ticker, rank() OVER (PARTITION BY ticker ORDER BY ret) + (count(*) OVER (PARTITION BY ticker, ret) - 1) / 2.0 AS ret FROM r)",
        select="SELECT x.ticker AS a, y.ticker AS b, round(CASE WHEN x.ticker = y.ticker THEN 1.0 ELSE corr(x.ret, y.ret) END, 6) AS rho FROM k x JOIN k y ON x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2",
    )
)
def spearman(spark, d):
    return rounded(C.spearman(panels.returns(spark, d, "prio_month")))


@query(
    panels.sql(
        "prio_month", _PAIRS, _COV,
        select="SELECT c.a, c.b, round(CASE WHEN c.a = c.b THEN 1.0 ELSE c.cov / sqrt(x.cov * y.cov) END, 6) AS rho FROM cv c JOIN cv x ON x.a = c.a AND x.b = c.a JOIN cv y ON y.a = c.b AND y.b = c.b",
    )
)
def corr_from_cov(spark, d):
    return rounded(C.correlation_of(C.covariance(panels.returns(spark, d, "prio_month"))))


@query(panels.sql("prio_month", _PAIRS, _RHO, select="SELECT a, b, round(sqrt(greatest(2 * (1 - rho), 0)), 6) AS distance FROM rho"))
def mantegna_distance(spark, d):
    return rounded(C.distance(C.correlation(panels.returns(spark, d, "prio_month"))).select("a", "b", "distance"))


_ROLL_CORR = "rc AS (SELECT date, a, b, rho FROM (SELECT date, a, b, corr(ra, rb) OVER w AS rho, count(*) OVER w AS n FROM pr WHERE a < b WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE n = 63)"


@query(panels.sql("flag", _PAIRS, _ROLL_CORR, select="SELECT date, a, b, round(rho, 6) AS rho FROM rc"))
def rolling_corr(spark, d):
    return rounded(C.rolling_correlation(panels.returns(spark, d, "flag")))


@query(panels.sql("flag", _PAIRS, _ROLL_CORR, select="SELECT date, round(avg(rho), 6) AS average, round(min(rho), 6) AS lowest, round(max(rho), 6) AS highest FROM rc GROUP BY date"))
def avg_corr(spark, d):
    return rounded(C.average_correlation(panels.returns(spark, d, "flag")))


@query(
    panels.sql(
        "flag", _BOOK, _PAIRS, _COV,
        "full_cv AS (SELECT a, b, cov FROM cv UNION ALL SELECT b, a, cov FROM cv WHERE a <> b)",
        "sw AS (SELECT a, sum(cov * weight) AS sw FROM full_cv JOIN book ON b = ticker GROUP BY a)",
        "x AS (SELECT ticker, weight, sw, weight * sw AS v, sqrt(sum(weight * sw) OVER ()) AS sigma FROM sw JOIN book ON a = ticker)",
        select="SELECT ticker, weight, round(sw / sigma, 6) AS marginal, round(v / sigma, 6) AS contribution, round(v / (sigma * sigma), 6) AS share, round(sigma, 6) AS sigma FROM x",
    )
)
def risk_decomposition(spark, d):
    rows = panels.returns(spark, d, "flag")
    return rounded(C.risk_decomposition(C.covariance(rows), panel.weights_frame(rows, FLAG_BOOK)))


_CFZ = f"({Z05!r} + ({Z05!r} * {Z05!r} - 1) / 6 * sk + (pow({Z05!r}, 3) - 3 * {Z05!r}) / 24 * ku - (2 * pow({Z05!r}, 3) - 5 * {Z05!r}) / 36 * sk * sk)"


@query(
    panels.sql(
        "flag",
        "s AS (SELECT ticker, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, (avg(pow(ret, 3)) - 3 * avg(ret) * avg(pow(ret, 2)) + 2 * pow(avg(ret), 3)) / pow(avg(pow(ret, 2)) - pow(avg(ret), 2), 1.5) AS sk, kurtosis_pop(ret) AS ku, -quantile_cont(ret, 0.05) AS v FROM r GROUP BY ticker)",
        "t AS (SELECT ticker, avg(ret) FILTER (WHERE ret <= -v) AS tail FROM r JOIN s USING (ticker) GROUP BY ticker)",
        select=f"SELECT ticker, n, round(v, 9) AS var_hist, round(coalesce(-tail, v), 9) AS cvar_hist, round(-(m + {Z05!r} * sd), 9) AS var_gauss, round(-(m + {_CFZ} * sd), 9) AS var_cf FROM s JOIN t USING (ticker)",
    )
)
def tail_measures(spark, d):
    return rounded(C.historical_tail(panels.returns(spark, d, "flag"), ["ticker"]), 9)


@query(
    panels.sql(
        "prio_month", "c AS (SELECT date, ticker, 100 * (ret - avg(ret) OVER (PARTITION BY ticker)) AS ret FROM r)",
        select="SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, round(avg(x.ret * y.ret), 9) AS xy, round(avg(x.ret * x.ret * y.ret * y.ret), 9) AS xxyy, round(avg(pow(x.ret, 3) * y.ret), 9) AS xxxy, round(avg(x.ret * pow(y.ret, 3)), 9) AS xyyy FROM c x JOIN c y ON x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2",
    )
)
def shrinkage_moments(spark, d):
    return rounded(C.moments(panels.returns(spark, d, "prio_month").withColumn("ret", 100 * F.col("ret"))), 9)


@query(
    panels.sql(
        "flag", _BOOK, _PAIRS,
        "cw AS (SELECT * FROM (SELECT date, a, b, covar_samp(ra, rb) OVER w AS cov, count(*) OVER w AS n FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE n = 63)",
        "fw AS (SELECT date, a, b, cov FROM cw UNION ALL SELECT date, b, a, cov FROM cw WHERE a <> b)",
        "rc AS (SELECT date, a, x.weight * sum(cov * y.weight) AS rc FROM fw JOIN book x ON a = x.ticker JOIN book y ON b = y.ticker GROUP BY date, a, x.weight)",
        select="SELECT date, a AS ticker, round(rc / sum(rc) OVER (PARTITION BY date), 6) AS share FROM rc",
    )
)
def rolling_risk_contribution(spark, d):
    return rounded(C.rolling_risk_contribution(panels.returns(spark, d, "flag"), FLAG_BOOK, decay=None).select("date", "ticker", "share"))


@query(
    panels.sql(
        "flag", _BOOK, _PAIRS,
        "ni AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY date) AS i FROM pr)",
        "cw AS (SELECT e.date, e.a, e.b, sum(pow(0.94, e.i - j.i) * j.ra * j.rb) AS cov FROM ni e JOIN ni j ON e.a = j.a AND e.b = j.b AND j.i BETWEEN e.i - 62 AND e.i WHERE e.i >= 63 GROUP BY 1, 2, 3)",
        "fw AS (SELECT date, a, b, cov FROM cw UNION ALL SELECT date, b, a, cov FROM cw WHERE a <> b)",
        "rc AS (SELECT date, a, x.weight * sum(cov * y.weight) AS rc FROM fw JOIN book x ON a = x.ticker JOIN book y ON b = y.ticker GROUP BY date, a, x.weight)",
        select="SELECT date, a AS ticker, round(rc / sum(rc) OVER (PARTITION BY date), 6) AS share FROM rc",
    )
)
def rolling_risk_ewma(spark, d):
    """The default form: weights that fall from each window's last date."""
    return rounded(C.rolling_risk_contribution(panels.returns(spark, d, "flag"), FLAG_BOOK).select("date", "ticker", "share"))


# ---------------------------------------------------------------- factors


def _market_pairs(spark, d) -> DataFrame:
    rows = panels.returns(spark, d, "flag")
    market = rows.groupBy("date").agg(F.avg("ret").alias("factor"))
    return rows.join(market, "date")


_MKT = "mk AS (SELECT date, avg(ret) AS factor FROM r GROUP BY date)"


@query(
    panels.sql(
        "flag", _MKT,
        select="SELECT ticker, date, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r_squared FROM (SELECT ticker, date, regr_slope(ret, factor) OVER w AS beta, regr_intercept(ret, factor) OVER w AS alpha, regr_r2(ret, factor) OVER w AS r2, count(*) OVER w AS n FROM r JOIN mk USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE n = 252",
    )
)
def rolling_beta(spark, d):
    return rounded(FA.rolling_beta(_market_pairs(spark, d), 252, ["ticker"]))


@query(
    panels.sql(
        "flag", _BOOK, _PORT, "fa AS (SELECT date, ret AS factor FROM r WHERE ticker = 'N')",
        select="SELECT 'one factor' AS model, count(*) AS n, round(regr_slope(ret, factor), 6) AS beta, round(regr_intercept(ret, factor), 6) AS alpha, round(regr_r2(ret, factor), 6) AS r_squared FROM port JOIN fa USING (date)",
    )
)
def factor_regression(spark, d):
    rows = panels.returns(spark, d, "flag")
    factor = rows.where("ticker = 'N'").select("date", F.col("ret").alias("factor"))
    m = FA.factor_model(FA.align(panel.portfolio_returns(rows, FLAG_BOOK), factor, ["factor"]))
    return rounded(spark.createDataFrame([("one factor", m.n_obs, float(m.betas[0]), m.alpha, m.r_squared)], "model string, n long, beta double, alpha double, r_squared double"))


_XY = "xy AS (SELECT date, max(ret) FILTER (WHERE ticker = 'A') AS y, max(ret) FILTER (WHERE ticker = 'N') AS f, max(ret) FILTER (WHERE ticker = 'R') AS h FROM r GROUP BY date)"
_ONE = [
    _XY,
    "ab AS (SELECT regr_intercept(y, f) AS a, regr_slope(y, f) AS b, count(*) AS n, sum(f) AS sf, sum(f * f) AS sff, var_samp(f) AS vf, avg(f) AS mf, avg(y) AS my FROM xy)",
    "re AS (SELECT date, y - a - b * f AS e, (y - a - b * f) * f AS g FROM xy, ab)",
    "ss AS (SELECT sum(e * e) AS sse FROM re)",
]
_HAC = [
    "lg AS (SELECT l, CASE WHEN l = 0 THEN 0.5 ELSE 1 - l / 6.0 END AS w FROM range(6) t(l))",
    "nr AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM re)",
    "me AS (SELECT sum(2 * w * x.e * p.e) AS m00, sum(w * (x.e * p.g + x.g * p.e)) AS m01, sum(2 * w * x.g * p.g) AS m11 FROM nr x JOIN lg ON TRUE JOIN nr p ON p.i = x.i - l)",
    "dt AS (SELECT *, n * sff - sf * sf AS dd FROM ab, me)",
    "se AS (SELECT a, b, sqrt((sff * sff * m00 - 2 * sff * sf * m01 + sf * sf * m11) / (dd * dd)) AS sa, sqrt((sf * sf * m00 - 2 * n * sf * m01 + n * n * m11) / (dd * dd)) AS sb FROM dt)",
]


def _one_factor(spark, d):
    wide = panel.to_wide(panels.returns(spark, d, "flag"), sorted(FLAG_BOOK), "ret")
    return FA.align(wide.select("date", F.col("A").alias("ret")), wide.select("date", "N"), ["N"])


@query(panels.sql("flag", *_ONE, *_HAC, select="SELECT 'alpha' AS term, round(a, 9) AS estimate, round(sa, 9) AS std_error, round(a / sa, 6) AS t_stat FROM se UNION ALL SELECT 'N', round(b, 9), round(sb, 9), round(b / sb, 6) FROM se"))
def newey_west_errors(spark, d):
    t = FA.factor_model(_one_factor(spark, d)).table(spark)
    return t.select("term", F.round("estimate", 9).alias("estimate"), F.round("std_error", 9).alias("std_error"), F.round("t_stat", 6).alias("t_stat"))


@query(panels.sql("flag", *_ONE, "va AS (SELECT *, sse / (n - 2) AS s2, sff - sf * sf / n AS sxx FROM ab, ss)", select="SELECT 'alpha' AS term, round(a, 9) AS estimate, round(sqrt(s2 * (1.0 / n + mf * mf / sxx)), 9) AS std_error FROM va UNION ALL SELECT 'N', round(b, 9), round(sqrt(s2 / sxx), 9) FROM va"))
def macro_sensitivities(spark, d):
    return rounded(stress.macro_sensitivities(_one_factor(spark, d)).table(spark).select("term", "estimate", "std_error"), 9)


@query(panels.sql("flag", *_ONE, "rk AS (SELECT b * b * vf * 252 AS sy, sse / (n - 2) * 252 AS sp FROM ab, ss)", select="SELECT round(sy, 9) AS systematic, round(sp, 9) AS specific, round(sqrt(sy + sp), 9) AS volatility, round(sy / (sy + sp), 9) AS share FROM rk"))
def factor_risk(spark, d):
    aligned = _one_factor(spark, d)
    risk = FA.factor_risk(FA.factor_model(aligned), FA.factor_covariance(aligned))
    return rounded(spark.createDataFrame([(risk["systematic"], risk["specific"], risk["volatility"], risk["shares"]["N"])], "systematic double, specific double, volatility double, share double"), 9)


@query(panels.sql("flag", *_ONE, select="SELECT round(a, 9) AS alpha, round(b * mf, 9) AS factor_part, round(my, 9) AS mean FROM ab"))
def factor_attribution(spark, d):
    aligned = _one_factor(spark, d)
    part = FA.attribution(aligned, FA.factor_model(aligned))
    return rounded(spark.createDataFrame([(part["alpha"], part["factors"]["N"], part["mean"])], "alpha double, factor_part double, mean double"), 9)


@query(
    panels.sql(
        "flag", _XY, "k AS (SELECT count(*) AS n, regr_slope(y, f) AS b1, regr_slope(h, f) AS b2, var_samp(f) AS vf, regr_sxx(y, f) AS sxx, regr_syy(y, f) AS syy, regr_syy(h, f) AS shh FROM xy)",
        select="SELECT a, b, round(cov * 252, 12) AS cov FROM (SELECT 'A' AS a, 'A' AS b, b1 * b1 * vf + (syy - b1 * b1 * sxx) / (n - 2) AS cov FROM k UNION ALL SELECT 'A', 'R', b1 * b2 * vf FROM k UNION ALL SELECT 'R', 'R', b2 * b2 * vf + (shh - b2 * b2 * sxx) / (n - 2) FROM k)",
    )
)
def factor_implied_covariance(spark, d):
    rows = panels.returns(spark, d, "flag")
    factor = rows.where("ticker = 'N'").select("date", F.col("ret").alias("N"))
    m = FA.estimate_implied_covariance(rows, factor, ["A", "R"], ["N"])
    return rounded(spark.createDataFrame([("A", "A", float(m[0, 0])), ("A", "R", float(m[0, 1])), ("R", "R", float(m[1, 1]))], "a string, b string, cov double"), 12)


@query(panels.sql("flag", _MKT, select="SELECT r.date, r.ticker, round(ret, 6) AS ret, round(factor, 6) AS factor FROM r JOIN mk USING (date)"))
def factor_alignment(spark, d):
    return rounded(_market_pairs(spark, d).select("date", "ticker", "ret", "factor"))


# ---------------------------------------------------------------- regimes

_VS = [
    "w AS (SELECT date, ticker, ret, CASE WHEN count(*) OVER o = 21 THEN stddev_samp(ret) OVER o END AS v FROM r WINDOW o AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))",
    "vf AS (SELECT date, ticker, ret, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS vol FROM w)",
    "cu AS (SELECT ticker, quantile_cont(vol, 1.0 / 3) AS c1, quantile_cont(vol, 2.0 / 3) AS c2 FROM vf GROUP BY ticker)",
    "st AS (SELECT date, vf.ticker, ret, vol, CAST(vol >= c1 AS INT) + CAST(vol >= c2 AS INT) AS state FROM vf JOIN cu USING (ticker) WHERE vol IS NOT NULL)",
]


@query(panels.sql("flag", *_VS, select="SELECT date, ticker, round(vol, 6) AS vol, CAST(state AS BIGINT) AS state FROM st"))
def volatility_states(spark, d):
    return rounded(regimes.volatility_states(panels.returns(spark, d, "flag")).select("date", "ticker", "vol", "state"))


@query(
    panels.sql(
        "flag", *_VS,
        "s AS (SELECT ticker, state, count(*) AS n, avg(ret) * 252 AS mean, stddev_samp(ret) * sqrt(252) AS volatility FROM st GROUP BY 1, 2)",
        select="SELECT ticker, CAST(state AS BIGINT) AS state, n, round(mean, 6) AS mean, round(volatility, 6) AS volatility, round(n / sum(n) OVER (PARTITION BY ticker), 6) AS frequency, round(mean / volatility, 6) AS ratio FROM s",
    )
)
def regime_statistics(spark, d):
    return rounded(regimes.state_statistics(regimes.volatility_states(panels.returns(spark, d, "flag")), by=["ticker"]))


_MARKET_STATES = "ms AS (SELECT date, state FROM st WHERE ticker = 'N')"


def _market_states(spark, d):
    return regimes.volatility_states(panels.returns(spark, d, "flag")).where("ticker = 'N'").select("date", "state")


@query(panels.sql("flag", *_VS, _MARKET_STATES, _MKT, select="SELECT CAST(state AS BIGINT) AS state, count(*) AS n, round(regr_slope(ret, factor), 6) AS beta FROM r JOIN ms USING (date) JOIN mk USING (date) WHERE ticker = 'A' GROUP BY state HAVING count(*) >= 2"))
def regime_beta(spark, d):
    rows = _market_pairs(spark, d).where("ticker = 'A'").withColumnRenamed("factor", "market").join(_market_states(spark, d), "date")
    return rounded(regimes.state_beta(rows))


@query(
    panels.sql(
        "flag", *_VS, _MARKET_STATES, _PAIRS,
        select="SELECT CAST(state AS BIGINT) AS state, round(avg(rho), 6) AS average FROM (SELECT state, a, b, corr(ra, rb) AS rho, count(*) AS n FROM pr JOIN ms USING (date) WHERE a < b GROUP BY 1, 2, 3) WHERE n >= 3 GROUP BY state",
    )
)
def regime_correlation(spark, d):
    return rounded(regimes.state_correlation(panels.returns(spark, d, "flag").join(_market_states(spark, d), "date")))


@query(panels.sql("flag", *_VS, _MARKET_STATES, select="SELECT o.date, CAST(coalesce(state, -1) AS BIGINT) AS state FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) o LEFT JOIN ms USING (date)"))
def states_aligned(spark, d):
    targets = read_table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return rounded(regimes.align_states(targets, _market_states(spark, d)))


# ---------------------------------------------------------------- stress

_WINDOWS = "wn AS (SELECT * FROM (VALUES ('first', DATE '1993-01-01', DATE '1993-06-30'), ('second', DATE '1994-03-01', DATE '1995-02-28'), ('late', DATE '1997-01-01', DATE '1999-12-31')) t(scenario, s, e))"
WINDOWS = [("first", "1993-01-01", "1993-06-30"), ("second", "1994-03-01", "1995-02-28"), ("late", "1997-01-01", "1999-12-31")]


@query(
    panels.sql(
        "flag", _BOOK, _WINDOWS,
        "x AS (SELECT scenario, date, sum(weight * ret) AS q, sum(weight) AS w FROM r JOIN book USING (ticker) JOIN wn ON date BETWEEN s AND e GROUP BY 1, 2)",
        "y AS (SELECT scenario, date, product(1 + q) OVER (PARTITION BY scenario ORDER BY date) AS g FROM x)",
        "z AS (SELECT *, g / max(g) OVER (PARTITION BY scenario ORDER BY date) - 1 AS dd FROM y)",
        select="SELECT scenario, count(*) AS n_days, round(arg_max(g, date) - 1, 9) AS pnl, round(min(dd), 9) AS max_drawdown, 1.0 AS covered FROM z GROUP BY scenario",
    )
)
def scenario_replay(spark, d):
    return rounded(stress.replay_assets(panels.returns(spark, d, "flag"), FLAG_BOOK, stress.scenarios(spark, WINDOWS)), 9)


@query(
    panels.sql(
        "flag", _BOOK, _WINDOWS,
        select="SELECT scenario, ticker, round(weight * (product(1 + ret) - 1), 6) AS contribution FROM r JOIN book USING (ticker) JOIN wn ON date BETWEEN s AND e GROUP BY scenario, ticker, weight",
    )
)
def scenario_contributions(spark, d):
    return rounded(stress.replay_contributions(panels.returns(spark, d, "flag"), FLAG_BOOK, stress.scenarios(spark, WINDOWS)))


_BETAS = "bt AS (SELECT * FROM (VALUES ('N', 1.1), ('R', -0.4)) t(ticker, beta))"
_BETA_DAYS = "fx AS (SELECT scenario, date, ticker AS factor, beta * ret AS part FROM r JOIN bt USING (ticker) JOIN wn ON date BETWEEN s AND e)"


def _factor_table(spark, d) -> DataFrame:
    return panels.returns(spark, d, "flag").select("date", F.col("ticker").alias("factor"), F.col("ret").alias("value"))


@query(
    panels.sql(
        "flag", _BETAS, _WINDOWS, _BETA_DAYS,
        "y AS (SELECT scenario, date, product(1 + q) OVER (PARTITION BY scenario ORDER BY date) AS g FROM (SELECT scenario, date, sum(part) AS q FROM fx GROUP BY 1, 2))",
        "z AS (SELECT *, g / max(g) OVER (PARTITION BY scenario ORDER BY date) - 1 AS dd FROM y)",
        select="SELECT scenario, count(*) AS n_days, round(arg_max(g, date) - 1, 9) AS pnl, round(min(dd), 9) AS max_drawdown FROM z GROUP BY scenario",
    )
)
def factor_replay(spark, d):
    return rounded(stress.replay_factors(_factor_table(spark, d), {"N": 1.1, "R": -0.4}, stress.scenarios(spark, WINDOWS)), 9)


@query(panels.sql("flag", _BETAS, _WINDOWS, _BETA_DAYS, select="SELECT scenario, factor, round(sum(part), 9) AS contribution FROM fx GROUP BY 1, 2"))
def factor_replay_contributions(spark, d):
    return rounded(stress.replay_factor_contributions(_factor_table(spark, d), {"N": 1.1, "R": -0.4}, stress.scenarios(spark, WINDOWS)), 9)


def _shock_sql(drivers: dict[str, str], shocks: dict[str, dict[str, float]]) -> str:
    """A row for each scenario: the moves times the drivers' sensitivities, columns of ``be``."""
    return " UNION ALL ".join(f"SELECT '{s}' AS scenario, round({' + '.join(f'{m!r} * {drivers[f]}' for f, m in moves.items())}, 6) AS pnl FROM be" for s, moves in shocks.items())


_WIDE_FLAGS = "wf AS (SELECT date, max(ret) FILTER (WHERE ticker = 'A') AS a, max(ret) FILTER (WHERE ticker = 'N') AS n, max(ret) FILTER (WHERE ticker = 'R') AS r FROM r GROUP BY date)"
_SLOPES = "be AS (SELECT regr_slope(a, n) AS b1, regr_slope(a, r) AS b2, regr_slope(n, r) AS b3, regr_slope(r, n) AS b4 FROM wf)"


def _slopes(spark, d) -> list[float]:
    wide = panel.to_wide(panels.returns(spark, d, "flag"), sorted(FLAG_BOOK), "ret")
    return list(wide.agg(F.regr_slope("A", "N"), F.regr_slope("A", "R"), F.regr_slope("N", "R"), F.regr_slope("R", "N")).first())


@query(panels.sql("flag", _WIDE_FLAGS, _SLOPES, select=_shock_sql({"Mkt-RF": "b1", "HML": "b2", "RMW": "b3"}, stress.FACTOR_SHOCKS)))
def factor_shocks(spark, d):
    """The named factor shocks under sensitivities that a table gives."""
    b = _slopes(spark, d)
    return rounded(stress.shock(spark, {"Mkt-RF": b[0], "HML": b[1], "RMW": b[2]}, stress.FACTOR_SHOCKS))


@query(panels.sql("flag", _WIDE_FLAGS, _SLOPES, select=_shock_sql({"rate_10y": "b1", "oil": "b2", "usd": "b3", "vix": "b4"}, stress.MACRO_SHOCKS)))
def macro_shocks(spark, d):
    return rounded(stress.shock(spark, dict(zip(("rate_10y", "oil", "usd", "vix"), _slopes(spark, d))), stress.MACRO_SHOCKS))


_MODEL_SHOCKS = {"CRASH": {"N": -0.2}, "BOTH": {"N": -0.1, "R": 0.05}, "REBOUND": {"R": 0.1}}


@query(
    panels.sql(
        "flag", _WIDE_FLAGS,
        "q AS (SELECT var_pop(n) AS sff, var_pop(r) AS shh, covar_pop(n, r) AS sfh, covar_pop(n, a) AS sfy, covar_pop(r, a) AS shy FROM wf)",
        "be AS (SELECT (sfy * shh - shy * sfh) / (sff * shh - sfh * sfh) AS bn, (shy * sff - sfy * sfh) / (sff * shh - sfh * sfh) AS br FROM q)",
        select=_shock_sql({"N": "bn", "R": "br"}, _MODEL_SHOCKS),
    )
)
def factor_shocks_fitted(spark, d):
    """Shocks of two factors under the betas of a fitted model."""
    wide = panel.to_wide(panels.returns(spark, d, "flag"), sorted(FLAG_BOOK), "ret")
    model = FA.factor_model(FA.AlignedFactors(wide.select("date", F.col("A").alias("ret"), "N", "R").dropna(), ("N", "R"), 0))
    return rounded(stress.factor_shock(spark, model, _MODEL_SHOCKS))


# ---------------------------------------------------------------- data quality


def _priced(spark, d, name="prio_day") -> DataFrame:
    return panels.panel(spark, d, name).select("date", "ticker", F.col("price").alias("adj_close"), F.lit("trading_days").alias("calendar"), F.lit("equity").alias("asset_class"))


@query("SELECT event_type AS ticker, count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE value <= 0) AS low FROM events GROUP BY event_type")
def quality_missing(spark, d):
    return read_table(spark, d, "events").groupBy(F.col("event_type").alias("ticker")).agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.col("value") <= 0).alias("low"))


_PRICED_RETS = "q AS (SELECT date, ticker, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM p)"


@query(
    panels.sql(
        "prio_day", _PRICED_RETS,
        "m AS (SELECT ticker, median(ret) AS m FROM q WHERE ret IS NOT NULL GROUP BY ticker)",
        "md AS (SELECT ticker, median(abs(ret - m)) AS mad FROM q JOIN m USING (ticker) WHERE ret IS NOT NULL GROUP BY ticker)",
        select="SELECT ticker, date, round(ret, 6) AS ret, CASE WHEN abs(ret) > 0.4 THEN 'critical' ELSE 'warning' END AS severity FROM q JOIN m USING (ticker) JOIN md USING (ticker) WHERE ret IS NOT NULL AND (abs(ret) > 0.2 OR (mad > 0 AND abs(ret - m) > 8 * 1.4826 * mad))",
    )
)
def quality_outliers(spark, d):
    return rounded(quality.outlier_events(_priced(spark, d)).select("ticker", "date", "ret", "severity"))


@query(
    """WITH s AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderstatus AS v, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pv FROM orders),
    f AS (SELECT *, coalesce(v = pv, false) AS same, sum(CASE WHEN coalesce(v = pv, false) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM s)
    SELECT k, max(n) + 1 AS longest FROM (SELECT k, run, count(*) AS n FROM f WHERE same GROUP BY 1, 2) GROUP BY k HAVING max(n) + 1 >= 3"""
)
def stale_runs(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.col("o_orderstatus").alias("v"))
    same = rows.withColumn("same", F.col("v") == F.lag("v").over(W.partitionBy("k").orderBy("i")))
    return performance.runs(same, F.col("same"), ["k"], "i").groupBy("k").agg((F.max("length") + 1).alias("longest")).where("longest >= 3")


@query(panels.sql("prio_day", select="SELECT ticker, count(*) AS n FROM (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM p) t CROSS JOIN (SELECT DISTINCT date FROM p) d ANTI JOIN p ON p.ticker = t.ticker AND p.date = d.date) GROUP BY ticker"))
def quality_calendar_gaps(spark, d):
    return quality.missing_dates(_priced(spark, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(panels.sql("prio_day", select="SELECT ticker, f AS \"from\", date AS \"to\", CAST(date - f AS BIGINT) AS days FROM (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS f FROM p) WHERE date - f > 4"))
def quality_observation_gaps(spark, d):
    return rounded(quality.gap_events(_priced(spark, d)).select("ticker", "from", "to", "days"))


@query()
def quality_report(spark, d):
    return quality.report(_priced(spark, d))


@query(
    panels.sql(
        "prio_day", _PRICED_RETS,
        "m AS (SELECT ticker, median(ret) AS m FROM q WHERE ret IS NOT NULL GROUP BY ticker)",
        "md AS (SELECT ticker, median(abs(ret - m)) AS mad FROM q JOIN m USING (ticker) WHERE ret IS NOT NULL GROUP BY ticker)",
        "ou AS (SELECT ticker, count(*) AS n, max(CASE WHEN abs(ret) > 0.4 THEN 1 ELSE 0 END) AS bad FROM q JOIN m USING (ticker) JOIN md USING (ticker) WHERE ret IS NOT NULL AND (abs(ret) > 0.2 OR (mad > 0 AND abs(ret - m) > 8 * 1.4826 * mad)) GROUP BY ticker)",
        "ca AS (SELECT ticker, count(*) AS n FROM (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM p) t CROSS JOIN (SELECT DISTINCT date FROM p) d ANTI JOIN p ON p.ticker = t.ticker AND p.date = d.date) GROUP BY ticker)",
        "ga AS (SELECT ticker, count(*) AS n FROM (SELECT ticker, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS days FROM p) WHERE days > 4 GROUP BY ticker)",
        "st AS (SELECT ticker, max(n) + 1 AS n FROM (SELECT ticker, run, count(*) AS n FROM (SELECT ticker, same, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS run FROM (SELECT ticker, date, coalesce(price = lag(price) OVER (PARTITION BY ticker ORDER BY date), false) AS same FROM p)) WHERE same GROUP BY 1, 2) GROUP BY ticker HAVING max(n) + 1 >= 5)",
        "sh AS (SELECT ticker, count(*) AS n FROM p GROUP BY ticker HAVING count(*) < 252)",
        select="""SELECT ticker, 'return_outliers' AS check_name, CASE WHEN bad = 1 THEN 'critical' ELSE 'warning' END AS severity, n FROM ou UNION ALL SELECT ticker, 'calendar_gaps', CASE WHEN n > 5 THEN 'warning' ELSE 'info' END, n FROM ca
            UNION ALL SELECT ticker, 'observation_gaps', 'info', n FROM ga UNION ALL SELECT ticker, 'stale_prices', 'warning', n FROM st UNION ALL SELECT ticker, 'short_history', 'warning', n FROM sh""",
    )
)
def quality_findings(spark, d):
    return quality.report(_priced(spark, d)).select("ticker", F.col("check").alias("check_name"), "severity", "n")


# ---------------------------------------------------------------- the store and its sources

_STORED = "sp AS (SELECT date, ticker, price * CASE WHEN year(date) = 1995 THEN 2 ELSE 1 END AS price FROM p)"


def _filled_store(spark, d):
    """The flags' prices as three tickers, then corrections of one year for all of them."""
    store = scratch_store(spark)
    rows = panels.panel(spark, d, "flag")
    for t in sorted(FLAG_BOOK):
        own = rows.where(F.col("ticker") == t).select("date", *[F.col("price").alias(c) for c in ("open", "high", "low", "close", "adj_close")], F.lit(1.0).alias("volume"))
        store.write_prices(t, own)
        store.write_prices(t, own.where("year(date) = 1995").withColumn("adj_close", 2 * F.col("adj_close")))
        store.write_asset(t, "trading_days", "equity", "test")
    store.write_asset("R", "continuous", "crypto", "test")
    return store


@query(panels.sql("flag", _STORED, select="SELECT date, round(max(price) FILTER (WHERE ticker = 'A'), 6) AS \"A\", round(max(price) FILTER (WHERE ticker = 'N'), 6) AS \"N\" FROM sp WHERE ticker IN ('A', 'N') AND date BETWEEN DATE '1994-06-01' AND DATE '1996-06-30' GROUP BY date"))
def store_prices(spark, d):
    return rounded(_filled_store(spark, d).read_prices(["A", "N", "missing"], "1994-06-01", "1996-06-30"))


@query(
    panels.sql(
        "flag", _STORED, "ac AS (SELECT date FROM sp WHERE ticker IN ('A', 'R') AND date >= DATE '1994-01-01' GROUP BY date HAVING count(*) = 2)",
        select="SELECT date, ticker, round(ln(price / prev), 6) AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM sp JOIN ac USING (date) WHERE ticker IN ('A', 'R')) WHERE prev IS NOT NULL",
    )
)
def store_returns(spark, d):
    return rounded(_filled_store(spark, d).read_returns(["A", "R"], "1994-01-01", kind="log").data)


@query(panels.sql("flag", select="SELECT ticker, max(date) AS last, CASE WHEN ticker = 'R' THEN 'continuous' ELSE 'trading_days' END AS calendar, CASE WHEN ticker = 'R' THEN 'crypto' ELSE 'equity' END AS asset_class FROM p GROUP BY ticker"))
def store_listing(spark, d):
    store = _filled_store(spark, d)
    meta = store.assets()
    return spark.createDataFrame([(t, store.last_date(t), store.calendar_for(t).value, meta[t]["asset_class"]) for t in store.available_tickers()], "ticker string, last date, calendar string, asset_class string")


@query(panels.sql("flag", select="SELECT date, round(max(ret) FILTER (WHERE ticker = 'A') * CASE WHEN year(date) = 1996 THEN -1 ELSE 1 END, 6) AS \"A\", round(max(ret) FILTER (WHERE ticker = 'R') * CASE WHEN year(date) = 1996 THEN -1 ELSE 1 END, 6) AS \"R\" FROM r WHERE date >= DATE '1995-01-01' GROUP BY date"))
def store_factors(spark, d):
    store = scratch_store(spark)
    rows = panels.returns(spark, d, "flag").select("date", F.col("ticker").alias("factor"), F.col("ret").alias("value"), F.lit("test").alias("source"))
    store.write_series(rows, "factors")
    store.write_series(rows.where("year(date) = 1996").withColumn("value", -F.col("value")), "factors")
    return rounded(store.read_factors(["A", "R"], "1995-01-01"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(sum(o_totalprice), 2) AS rate FROM orders GROUP BY 1 HAVING CAST(date_trunc('month', o_orderdate) AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'")
def store_rates(spark, d):
    store = scratch_store(spark)
    rows = read_table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    store.write_series(rows.select("date", F.lit("rate").alias("series_id"), "value", F.lit("USD").alias("currency"), F.lit("test").alias("source")), "rates")
    return rounded(store.read_rates(None, "1993-01-01", "1995-12-31"), 2)


@query(panels.sql("flag", select="SELECT date, ticker, round(price, 6) AS adj_close FROM p WHERE date >= DATE '1993-01-01' AND ticker <> 'N'"))
def incremental_ingest(spark, d):
    """Prices fetched in two runs, the second from each ticker's last date on; one ticker's source fails."""
    datasource.register(spark)
    landed, store = _landed_charts(spark, panels.panel(spark, d, "flag").where("ticker <> 'N'")), scratch_store(spark)
    for until in ("1995-12-31", None):
        datasource.ingest_series(store, "prices", sorted(FLAG_BOOK), "1993-01-01", until, landed)
    return rounded(store.table("prices").select("date", "ticker", "adj_close"))


def _landed(spark, kind: str, lines: DataFrame) -> str:
    """Lines (series, n, line) as the texts that a provider's files would be; the folder they lie in."""
    base = f"{scratch_dir(spark)}/landed-{uuid.uuid4().hex}"
    lines.repartition("series").sortWithinPartitions("series", "n").select("series", F.col("line").alias("value")).write.partitionBy("series").text(f"{base}/{kind}")
    return base


def _landed_charts(spark, prices: DataFrame) -> str:
    """A chart answer for each ticker of (date, ticker, price)."""
    rows = prices.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col("date").cast("timestamp")).alias("t"), "price"))).alias("r"))
    closes = F.col("r.price")
    quote = F.struct(*[closes.alias(c) for c in ("open", "high", "low", "close")], F.transform("r", lambda x: F.lit(1.0)).alias("volume"))
    result = F.struct(F.col("r.t").alias("timestamp"), F.struct(F.lit(0).alias("gmtoffset")).alias("meta"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return _landed(spark, "prices", rows.select(F.col("ticker").alias("series"), F.lit(0).alias("n"), F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("line")))


@query(panels.sql("flag", select="SELECT date, ticker, round(price, 6) AS close FROM p WHERE ticker <> 'R' AND date > DATE '1994-03-01' AND date <= DATE '1997-06-30'"))
def source_prices(spark, d):
    """Chart answers read by the data source, bounds and tickers pushed down to it."""
    datasource.register(spark)
    landed = _landed_charts(spark, panels.panel(spark, d, "flag"))
    rows = datasource.series(spark, "prices", sorted(FLAG_BOOK), landed=landed)
    rows = rows.where((F.col("date") > F.lit("1994-03-01").cast("date")) & (F.col("date") <= F.lit("1997-06-30").cast("date")) & F.col("ticker").isin("A", "N") & F.col("error").isNull())
    return rounded(rows.select("date", "ticker", "close"))


def _monthly_orders(spark, d) -> DataFrame:
    return read_table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(F.count(F.lit(1)).alias("k"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1 HAVING month(CAST(date_trunc('month', o_orderdate) AS DATE)) <> 3")
def parse_rates_csv(spark, d):
    """A provider's text with missing values (March's), fetched and parsed in executors."""
    datasource.register(spark)
    months = _monthly_orders(spark, d).select(F.date_format("m", "yyyy-MM-dd").alias("n"), F.when(F.month("m") == 3, F.lit(".")).otherwise(F.col("k").cast("string")).alias("v"))
    head = spark.range(1).select(F.lit("").alias("n"), F.lit("observation_date,X").alias("line"))
    lines = head.unionByName(months.select("n", F.concat_ws(",", "n", "v").alias("line"))).withColumn("series", F.lit("USD_2Y"))
    return datasource.series(spark, "rates", ["USD_2Y"], landed=_landed(spark, "rates", lines)).where("error is null").select("date", "value")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, factor, CAST(CASE factor WHEN 'N' THEN count(*) ELSE -count(*) END AS DOUBLE) / 100 AS value FROM orders, (VALUES ('N'), ('Neg')) t(factor) GROUP BY 1, 2")
def parse_factors_csv(spark, d):
    """A provider's block of daily rows between other text, in percent, turned into long decimals by a table function."""
    datasource.register_table_functions(spark)
    text = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("line")) for n, t in (("0", "Some text"), ("1", ""), ("10000101", ",N,Neg"), ("99990101", " Annual"), ("99990102", "1999, 1, 2"))])).alias("x")).select("x.*")
    months = _monthly_orders(spark, d).select(F.date_format("m", "yyyyMMdd").alias("n"), F.format_string("%s,  %d.00, %d.00", F.date_format("m", "yyyyMMdd"), F.col("k"), -F.col("k")).alias("line"))
    text.unionByName(months).withColumn("file", F.lit("a")).createOrReplaceTempView("__factor_lines")
    return spark.sql("SELECT date, factor, value FROM factor_blocks(TABLE(__factor_lines))")


@query("SELECT CAST(ts AS DATE) AS date, round(arg_max(value, epoch_ms(ts) * 1000000 + event_id), 6) AS close FROM events GROUP BY 1")
def parse_candles(spark, d):
    """Candles of a day and their last one, as an exchange's pages give them."""
    rows = read_table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "value")
    last = panel.top_k(rows, ["ms"], [F.desc("event_id")], 1)
    candles = last.select(F.col("ms").alias("ts"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    return rounded(parsers.exchange_candles(candles, "X").select("date", "close"))


# ---------------------------------------------------------------- more of panels, regimes, stress


@query(panels.sql("flag", "rf AS (SELECT date, avg(ret) / 10 AS rf FROM r WHERE month(date) <> 7 GROUP BY date)", select="SELECT date, ticker, round(ret - rf, 9) AS excess FROM r JOIN rf USING (date)"))
def excess_over_series(spark, d):
    rows = panels.returns(spark, d, "flag")
    rate = rows.where("month(date) <> 7").groupBy("date").agg((F.avg("ret") / 10).alias("rf"))
    return rounded(panel.excess(rows, 252, rate).select("date", "ticker", "excess"), 9)


@query(panels.sql("flag", *_VS, _MARKET_STATES, select="SELECT CAST(state AS BIGINT) AS state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS frequency FROM ms GROUP BY state"))
def state_frequencies(spark, d):
    return rounded(regimes.frequencies(_market_states(spark, d)), 9)


@query(
    panels.sql(
        "flag", _BOOK, _WINDOWS, "x AS (SELECT scenario, date, sum(weight * ret) AS q FROM r JOIN book USING (ticker) JOIN wn ON date BETWEEN s AND e GROUP BY 1, 2)", "y AS (SELECT scenario, product(1 + q) - 1 AS pnl FROM x GROUP BY scenario)",
        select="SELECT arg_min(scenario, pnl) AS scenario, round(min(pnl), 9) AS pnl FROM y",
    )
)
def worst_scenario(spark, d):
    return rounded(stress.worst(stress.replay_assets(panels.returns(spark, d, "flag"), FLAG_BOOK, stress.scenarios(spark, WINDOWS))), 9)


@query(
    panels.sql(
        "flag", "bk2 AS (SELECT * FROM (VALUES ('A', 0.2), ('N', 0.2), ('R', 0.6)) t(ticker, weight))", _PAIRS, _COV,
        "full_cv AS (SELECT a, b, cov FROM cv UNION ALL SELECT b, a, cov FROM cv WHERE a <> b)",
        "x AS (SELECT a AS ticker, wa.weight, wa.weight * sum(cov * wb.weight) AS v FROM full_cv JOIN bk2 wa ON wa.ticker = a JOIN bk2 wb ON wb.ticker = b GROUP BY 1, 2)",
        select="SELECT ticker, round(share, 6) AS share FROM (SELECT ticker, weight, v / sum(v) OVER () AS share FROM x) WHERE share > 1.2 * weight",
    )
)
def overweight_risk(spark, d):
    rows = panels.returns(spark, d, "flag")
    book = panel.weights_frame(rows, {"A": 0.2, "N": 0.2, "R": 0.6})
    return rounded(C.overweight(C.risk_decomposition(C.covariance(rows), book), 1.2).select("ticker", "share"))


# ---------------------------------------------------------------- schedules, upserts, joins


def _schedule_sql(key: str) -> str:
    return f"SELECT max(d) AS date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY {key}"


def _order_dates(spark, d):
    return read_table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


@query(_schedule_sql("d"))
def schedule_daily(spark, d):
    return panel.schedule(_order_dates(spark, d), "daily")


@query(_schedule_sql("year(d)"))
def schedule_annual(spark, d):
    return panel.schedule(_order_dates(spark, d), "annual")


@query(_schedule_sql("isoyear(d), week(d)"))
def schedule_weekly(spark, d):
    return panel.schedule(_order_dates(spark, d), "weekly")


@query(_schedule_sql("year(d), month(d)"))
def schedule_monthly(spark, d):
    return panel.schedule(_order_dates(spark, d), "monthly")


@query(_schedule_sql("year(d), quarter(d)"))
def schedule_quarterly(spark, d):
    return panel.schedule(_order_dates(spark, d), "quarterly")


@query(
    """WITH n AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem)
    SELECT l_orderkey, l_partkey, l_quantity FROM n WHERE rn = 1"""
)
def keep_last_rows(spark, d):
    return panel.keep_last(read_table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_quantity"]).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'corrected' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_new_wins(spark, d):
    old = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = old.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("corrected"))
    return panel.upserted(old, new, ["o_orderkey"])


@query(
    """WITH q AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT q.event_id, round(e.seen, 6) AS seen FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.ts >= e.ts"""
)
def as_of_join(spark, d):
    events = read_table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    return rounded(panel.as_of(left, right, ["user_id"], "ts", "ts", ["seen"]).select("event_id", "seen"))


@query(ORACLES["as_of_join"])
def as_of_join_split(spark, d):
    """The same with each user's events split by month."""
    events = read_table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    return rounded(panel.as_of(left, right, ["user_id"], "ts", "ts", ["seen"], split="month").select("event_id", "seen"))


@query(
    panels.sql(
        "flag", "t AS (SELECT o.date AS as_of, max(r.date) AS known FROM (SELECT DISTINCT date FROM r WHERE ticker = 'A') o JOIN (SELECT date FROM r WHERE ticker = 'A') r ON r.date <= o.date - INTERVAL 45 DAY GROUP BY o.date)",
        select="SELECT as_of, known, round(ret, 6) AS ret FROM t JOIN r ON r.date = known AND r.ticker = 'A'",
    )
)
def publication_lag(spark, d):
    rows = panels.returns(spark, d, "flag").where("ticker = 'A'")
    left = rows.select("ticker", F.col("date").alias("as_of"))
    got = panel.as_of(left, rows.withColumn("known", F.col("date")), ["ticker"], "as_of", "date", ["known", "ret"], 45)
    return rounded(got.where("known is not null").select("as_of", "known", "ret"))


@query(panels.sql("flag", _WINDOWS, select="SELECT r.date, r.ticker, scenario FROM r JOIN wn ON r.date BETWEEN s AND e"))
def fold_ranges(spark, d):
    return panel.within_ranges(panels.returns(spark, d, "flag"), stress.scenarios(spark, WINDOWS), "start", "end").select("date", "ticker", "scenario")


@query(
    """WITH o AS (SELECT year(o_orderdate) AS y, o_orderpriority AS ticker, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1, 2),
    c AS (SELECT ticker, v / sum(v) OVER () AS w FROM o WHERE y = 1995 AND ticker <> '5-LOW'), t AS (SELECT ticker, v / sum(v) OVER () AS w FROM o WHERE y = 1996 AND ticker <> '1-URGENT')
    SELECT ticker, round(coalesce(c.w, 0), 6) AS current, round(coalesce(t.w, 0), 6) AS target, round(coalesce(t.w, 0) - coalesce(c.w, 0), 6) AS delta FROM c FULL JOIN t USING (ticker)"""
)
def rebalance_deltas(spark, d):
    """From a year's shares of orders to the next one's, with a class that leaves and one that comes."""
    sums = read_table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("ticker")).agg(F.sum("o_totalprice").alias("v"))
    share = F.col("v") / F.sum("v").over(W.partitionBy("y"))
    books = [sums.where((F.col("y") == y) & (F.col("ticker") != gone)).select("ticker", share.alias("weight")) for y, gone in ((1995, "5-LOW"), (1996, "1-URGENT"))]
    return rounded(backtest.deltas(*books))


# ---------------------------------------------------------------- other aggregates


@query("SELECT c_mktsegment, round(1 / sum(w * w), 6) AS effective_n, round(sum(abs(w)), 6) AS gross, round(sum(w), 6) AS net FROM (SELECT c_mktsegment, c_acctbal / sum(abs(c_acctbal)) OVER (PARTITION BY c_mktsegment) AS w FROM customer) GROUP BY c_mktsegment")
def effective_positions(spark, d):
    w = F.col("c_acctbal") / F.sum(F.abs("c_acctbal")).over(W.partitionBy("c_mktsegment"))
    rows = read_table(spark, d, "customer").select("c_mktsegment", w.alias("w"))
    return rounded(C.exposures(rows, ["c_mktsegment"], "w"))


@query(
    panels.sql(
        "flag", "u AS (SELECT ticker, quantile_cont(-ret, 0.95) AS u, count(*) AS n FROM r GROUP BY ticker)", "e AS (SELECT r.ticker, -ret AS loss, u, n FROM r JOIN u USING (ticker) WHERE -ret > u)",
        select="SELECT ticker, round(u, 9) AS threshold, n, round(loss, 9) AS loss, round((row_number() OVER (PARTITION BY ticker ORDER BY loss) - 0.5) / count(*) OVER (PARTITION BY ticker), 9) AS position FROM e",
    )
)
def exceedance_positions(spark, d):
    return rounded(C.exceedances(panels.returns(spark, d, "flag"), ["ticker"]).select("ticker", "threshold", "n", "loss", "position"), 9)


@query("SELECT o_custkey, o_orderdate, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM orders")
def cumulative_cost(spark, d):
    rows = backtest.cumulated(read_table(spark, d, "orders"), "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", "o_orderdate", F.round("cumulative_o_totalprice", 2).alias("cumulative"))


@query("SELECT l_suppkey, l_partkey, quantity FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS k FROM lineitem GROUP BY 1, 2) WHERE k <= 3")
def top_by_group(spark, d):
    sums = read_table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return panel.top_k(sums, ["l_suppkey"], [F.desc("quantity"), "l_partkey"], 3)


@query("SELECT CAST(o_orderdate AS DATE) AS date, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2) AS urgent, round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END), 2) AS low FROM orders GROUP BY 1")
def pivot_wide(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker"), "o_totalprice")
    sums = rows.groupBy("date", "ticker").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return panel.to_wide(sums, ["1-URGENT", "5-LOW"], "total").withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("SELECT s_suppkey, name, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (v FOR name IN (nation, balance))")
def unpivot_long(spark, d):
    rows = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return panel.to_long(rows, "v", "name", ["s_suppkey"])


# ---------------------------------------------------------------- the SQL surface

_SQL = {
    "sql_price_summary": "SELECT l_returnflag AS ticker, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last, round(avg(l_extendedprice), 2) AS mean FROM lineitem GROUP BY l_returnflag",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "sql_ranking": "SELECT c_custkey, c_mktsegment, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)",
    "sql_union_all": "SELECT s_nationkey AS nation FROM supplier UNION ALL SELECT c_nationkey FROM customer",
    "sql_union": "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer",
    "sql_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
    "sql_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "sql_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "sql_correlated": "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 5",
    "sql_case_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(avg(CASE WHEN value <= 50 THEN value END), 6) AS low_mean FROM events GROUP BY event_type",
    "sql_star_join": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "sql_recursive": "WITH RECURSIVE t(n, path) AS (SELECT r_regionkey, CAST(r_name AS STRING) FROM region WHERE r_regionkey = 0 UNION ALL SELECT r.r_regionkey, concat(t.path, '>', r.r_name) FROM t JOIN region r ON r.r_regionkey = t.n + 1) SELECT n, path FROM t",
    "sql_full_join": "SELECT coalesce(s.nation, c.nation) AS nation, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) c ON s.nation = c.nation",
    "sql_distinct_on": "SELECT o_custkey, o_orderkey AS largest FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "sql_tumbling": "SELECT CAST(ts AS DATE) AS day, event_type AS ticker, round(avg(value), 6) AS price, count(*) AS n FROM events GROUP BY 1, 2",
}


def _surface(name: str, text: str) -> Query:
    def run(spark, d):
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if t in words:
                read_table(spark, d, t).createOrReplaceTempView(t)
        return rounded(spark.sql(text), 6)

    run.__name__ = name
    return run


for _name, _text in _SQL.items():
    QUERIES[_name] = _surface(_name, _text)
    _int = {"sql_union_all": "SELECT CAST(nation AS BIGINT) AS nation FROM (%s)", "sql_union": "SELECT CAST(nation AS BIGINT) AS nation FROM (%s)", "sql_full_join": "SELECT CAST(nation AS BIGINT) AS nation, suppliers, customers FROM (%s)", "sql_grouping_sets": "SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, n FROM (%s)"}
    ORACLES[_name] = _int.get(_name, "%s") % _text


@query("SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, round(avg(l_extendedprice), 6) AS adj_close FROM lineitem GROUP BY 1, 2")
def sql_table_function(spark, d):
    table_function(spark, "flag_prices", panels.panel(spark, d, "flag").select("date", "ticker", F.col("price").alias("adj_close")))
    return rounded(spark.sql("SELECT date, ticker, adj_close FROM flag_prices()"))


def _event_times(spark, d) -> DataFrame:
    events = read_table(spark, d, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(ts AS DATE) AS date, event_type AS ticker, round(avg(value), 6) AS price, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_bars(spark, d):
    return rounded(twins.daily_bars(_event_times(spark, d)))


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type AS ticker, value FROM events)
    SELECT CAST(day + CAST(k + 1 AS INTEGER) AS TIMESTAMP) AS "end", ticker, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM d, range(7) t(k) GROUP BY 1, 2"""
)
def stream_rolling_mean(spark, d):
    out = twins.rolling_mean(_event_times(spark, d)).withColumn("end", F.col("end").cast("timestamp_ntz"))
    return rounded(out)


@query(
    """WITH b AS (SELECT CAST(ts AS DATE) AS date, event_type AS ticker, avg(value) AS price FROM events GROUP BY 1, 2),
    p AS (SELECT *, max(price) OVER (PARTITION BY ticker ORDER BY date) AS peak FROM b)
    SELECT date, ticker, round(price, 6) AS price, round(peak, 6) AS peak, round(price / peak - 1, 6) AS drawdown FROM p"""
)
def stream_drawdowns(spark, d):
    """The state after each bar, as the stream keeps it, over a whole table."""
    bars = twins.daily_bars(_event_times(spark, d)).select("date", "ticker", "price")
    return rounded(bars.groupBy("ticker").applyInPandas(twins.drawdowns_of_batch, twins.DRAWDOWNS))


def _trickled(spark, rows: DataFrame, at: str, closing: DataFrame, late: str = "40 days") -> DataFrame:
    """A stream of a table's rows that come in three batches, each up to 30 days from its place in time, then ``closing``."""
    folder = f"{scratch_dir(spark)}/trickle-{uuid.uuid4().hex}"
    moved = F.col(at) + F.make_dt_interval(F.pmod(F.xxhash64(*rows.columns), F.lit(30)).cast("int"))
    batch = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.months_between(moved, F.lit("1992-01-01").cast("timestamp")) / 30)))
    rows = staged(rows.withColumn("__batch", batch), "trickle")
    for number in range(3):
        rows.where(F.col("__batch") == number).drop("__batch").repartition(1).write.mode("append").parquet(folder)
    closing.select(*[F.col(c).cast(t) for c, t in rows.drop("__batch").dtypes]).repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop("__batch").schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark(at, late)


_BOOKS = {"even": FLAG_BOOK, "one": {"N": 1.0}}


@query(
    panels.sql(
        "flag", "bk AS (SELECT * FROM (VALUES ('even', 'A', 0.5), ('even', 'N', 0.3), ('even', 'R', 0.2), ('one', 'N', 1.0)) t(run_id, ticker, weight))",
        "gw AS (SELECT date, ticker, date_trunc('month', date) AS per, product(1 + ret) OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date) AS g FROM r)",
        "vl AS (SELECT run_id, date, per, sum(weight * g) AS v FROM gw JOIN bk USING (ticker) GROUP BY 1, 2, 3)",
        "ed AS (SELECT run_id, per, arg_max(v, date) AS f FROM vl GROUP BY 1, 2)",
        "bs AS (SELECT run_id, per, coalesce(product(f) OVER (PARTITION BY run_id ORDER BY per ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS base FROM ed)",
        "eq AS (SELECT run_id, date, base * v AS equity FROM vl JOIN bs USING (run_id, per))",
        select="SELECT run_id, date, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY run_id ORDER BY date) - 1, 6) AS drawdown FROM eq",
    )
)
def stream_books(spark, d):
    """Books by run as a stream of shuffled bars, read through to its end."""
    runs = F.explode(F.array(*[F.lit(k) for k in _BOOKS])).alias("run_id")
    rows = panels.returns(spark, d, "flag").select(runs, F.col("date").cast("timestamp").alias("at"), "ticker", "ret")
    closing = spark.range(1).select(runs, F.lit("2200-01-01").cast("timestamp").alias("at"), F.lit("A").alias("ticker"), F.lit(0.0).alias("ret"))
    found = twins.finished(twins.book_stream(_trickled(spark, rows, "at", closing), _BOOKS), "books")
    return rounded(found.where("date < '2200-01-01'").select("run_id", "date", "equity", "drawdown"))


@query(ORACLES["stream_drawdowns"])
def stream_drawdowns_shuffled(spark, d):
    """The drawdowns of bars that come in any order within the watermark, from the stream itself."""
    bars = panels.panel(spark, d, "event_day").select("ticker", F.col("date").cast("timestamp").alias("at"), "price")
    closing = bars.select("ticker").distinct().select("ticker", F.lit("2200-01-01").cast("timestamp").alias("at"), F.lit(0.0).alias("price"))
    found = twins.finished(twins.ordered_drawdown_stream(_trickled(spark, bars, "at", closing)), "drawdowns")
    return rounded(found.where("date < '2200-01-01'"))


@query(ORACLES["publication_lag"])
def stream_publication_lag(spark, d):
    """``publication_lag`` as a join of two streams that both come shuffled."""
    rows = staged(panels.returns(spark, d, "flag").where("ticker = 'A'").select("ticker", F.col("date").cast("timestamp").alias("at"), "ret"), "lagged")
    far = spark.range(1).select(F.lit("A").alias("ticker"), F.lit("2200-01-01").cast("timestamp").alias("at"), F.lit(0.0).alias("ret"))
    asked = _trickled(spark, rows.select("ticker", F.col("at").alias("as_of")), "as_of", far.withColumnRenamed("at", "as_of"))
    found = twins.finished(twins.lagged_join_stream(asked, _trickled(spark, rows, "at", far)), "lagged").where("as_of < '2200-01-01'")
    return rounded(found.select(F.col("as_of").cast("date").alias("as_of"), F.col("known").cast("date").alias("known"), "ret"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def stream_series(spark, d):
    """A provider's series as a stream with its high-water mark as the offset, stopped and resumed once."""
    datasource.register(spark)
    months = _monthly_orders(spark, d).select(F.lit("USD_2Y").alias("series"), F.date_format("m", "yyyy-MM-dd").alias("n"), F.concat_ws(",", F.date_format("m", "yyyy-MM-dd"), F.col("k").cast("string")).alias("line"))
    head = spark.range(1).select(F.lit("USD_2Y").alias("series"), F.lit("").alias("n"), F.lit("observation_date,X").alias("line"))
    base = _landed(spark, "rates", head.unionByName(months.where("n < '1996-01-01'")))
    out = f"{scratch_dir(spark)}/series-{uuid.uuid4().hex}"
    for part in range(2):
        if part:
            months.where("n >= '1996-01-01'").repartition(1).sortWithinPartitions("n").select("series", F.col("line").alias("value")).write.mode("append").partitionBy("series").text(f"{base}/rates")
        rows = spark.readStream.format("series").option("kind", "rates").option("names", "USD_2Y").option("landed", base).load()
        q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/marks").start()
        q.processAllAvailable()
        q.stop()
    return spark.read.parquet(f"{out}/rows").where("error is null").select("date", "value")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, k"""
)
def gap_sessions(spark, d):
    rows = read_table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = F.session_window("ts", "4 hours")
    return rows.groupBy("user_id", w).agg(F.min("ts").cast("timestamp_ntz").alias("first"), F.max("ts").cast("timestamp_ntz").alias("last"), F.count(F.lit(1)).alias("n")).drop("session_window")


# ---------------------------------------------------------------- backtests

_MONTHLY = [
    "bk AS (SELECT ticker, 1.0 / count(*) OVER () AS weight FROM (SELECT DISTINCT ticker FROM r))",
    "dn AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM r))",
    "dc AS (SELECT max(date) AS date, 1 AS dec FROM dn WHERE TRUE GROUP BY year(date), month(date) HAVING max(i) >= 21)",
    "dy AS (SELECT dn.date, coalesce(dec, 0) AS dec, coalesce(sum(coalesce(dec, 0)) OVER (ORDER BY dn.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS per FROM dn LEFT JOIN dc USING (date))",
    "rw AS (SELECT r.date, r.ticker, per, dec, weight, product(1 + ret) OVER (PARTITION BY r.ticker, per ORDER BY r.date) AS g FROM r JOIN bk USING (ticker) JOIN dy USING (date) WHERE per > 0)",
    "br AS (SELECT date, per, dec, 1 + sum(weight * (g - 1)) AS v FROM rw GROUP BY 1, 2, 3)",
    "cs AS (SELECT br.date, br.per, br.dec, br.v, CASE WHEN br.dec = 1 THEN sum(abs(rw.weight - rw.weight * rw.g / br.v)) * 0.001 ELSE 0 END AS cost FROM br JOIN rw ON rw.date = br.date GROUP BY 1, 2, 3, 4)",
    "en AS (SELECT 0 AS per, 1 - 0.001 AS f UNION ALL SELECT per, v * (1 - cost) FROM cs WHERE dec = 1)",
    "ch AS (SELECT per + 1 AS per, product(f) OVER (ORDER BY per) AS base FROM en)",
]


@query(panels.sql("flag", *_MONTHLY, select="SELECT date, round(equity, 6) AS equity FROM (SELECT date, base * v * (1 - cost) AS equity FROM cs JOIN ch USING (per) UNION ALL SELECT min(date), 1 - 0.001 FROM dc)"))
def backtest_static(spark, d):
    rows = panels.returns(spark, d, "flag")
    book = panel.weights_frame(rows, dict.fromkeys(FLAG_BOOK, 1 / 3))
    return rounded(backtest.run_static(rows, book, "monthly", 21).select("date", "equity"))


@query(panels.sql("flag", *_MONTHLY, select="SELECT date, round(equity, 6) AS equity FROM (SELECT date, base * v * (1 - cost) AS equity FROM cs JOIN ch USING (per) UNION ALL SELECT min(date), 1 - 0.001 FROM dc)"))
def backtest_grouped(spark, d):
    config = backtest.BacktestConfig(lookback=21, dust=0.0)
    rows = backtest.run_all(panels.returns(spark, d, "flag"), [strategies.EqualWeight()], config)
    return rounded(rows.where("kind = 'equity'").select("date", "equity"))


STRATEGIES = [strategies.EqualWeight(), strategies.MinimumVariance(), strategies.RiskParity(), strategies.HierarchicalRiskParity(), strategies.InverseVolatility(), strategies.Momentum(), strategies.DeriskOnDrawdown("N"), strategies.RegimeAware("N")]
_FILLS = "fl AS (SELECT (SELECT min(date) FROM dc) AS date, ticker, weight AS d FROM bk UNION ALL SELECT rw.date, rw.ticker, rw.weight - rw.weight * rw.g / br.v FROM rw JOIN br USING (date) WHERE rw.dec = 1)"


def _equal_run(spark, d) -> DataFrame:
    return backtest.run_all(panels.returns(spark, d, "flag"), [strategies.EqualWeight()], backtest.BacktestConfig(lookback=21, dust=0.0))


@query(panels.sql("flag", *_MONTHLY, _FILLS, select="SELECT 'equal_weight' AS run_id, ticker, round(sum(abs(d)), 9) AS turnover, round(sum(abs(d)) * 0.001, 9) AS cost, count(*) AS n_trades FROM fl GROUP BY ticker"))
def backtest_trades(spark, d):
    return rounded(backtest.trades_by_asset(_equal_run(spark, d)), 9)


@query(panels.sql("flag", *_MONTHLY, _FILLS, select="SELECT 'equal_weight' AS run_id, date, round(turnover, 9) AS turnover, round(turnover * 0.001, 9) AS cost, round(sum(turnover * 0.001) OVER (ORDER BY date), 9) AS cumulative_cost FROM (SELECT date, sum(abs(d)) AS turnover FROM fl GROUP BY date)"))
def backtest_costs(spark, d):
    return rounded(backtest.trades_by_date(_equal_run(spark, d)), 9)


@query(
    panels.sql(
        "flag", *_MONTHLY, _FILLS, "eq AS (SELECT date, base * v * (1 - cost) AS equity FROM cs JOIN ch USING (per))",
        select="SELECT 'equal_weight' AS run_id, round(sum(abs(d)), 9) AS turnover, round(sum(abs(d)) * 0.001, 9) AS total_cost, count(DISTINCT date) AS n_rebalances, round((SELECT arg_max(equity, date) FROM eq), 9) AS final_equity FROM fl",
    )
)
def backtest_totals(spark, d):
    return rounded(backtest.run_metrics(_equal_run(spark, d)).select("run_id", "turnover", "total_cost", "n_rebalances", "final_equity"), 9)


@query()
def backtest_strategies(spark, d):
    rows = panels.returns(spark, d, "flag")
    config = backtest.BacktestConfig(lookback=126, regime=True, regime_restarts=1, regime_refit="annual")
    return rounded(backtest.run_metrics(backtest.run_all(rows, STRATEGIES, config, panel.equal_weight_returns(rows))))


def _folds(rows: DataFrame) -> list:
    dates = [r[0] for r in rows.select("date").distinct().orderBy("date").collect()]  # one track of dates
    return walkforward.make_folds(dates, 4, min_train=max(60, min(504, len(dates) // 3)))


_FOLDED = [
    "bk AS (SELECT ticker, 1.0 / count(*) OVER () AS weight FROM (SELECT DISTINCT ticker FROM r))",
    "nd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM r))",
    "fo AS (SELECT fold, m + CAST(floor((n - m) * fold / 4.0) AS BIGINT) AS lo, m + CAST(floor((n - m) * (fold + 1) / 4.0) AS BIGINT) - 1 AS hi FROM (SELECT DISTINCT n, greatest(60, least(504, n // 3)) AS m FROM nd), range(4) t(fold))",
    "fd AS (SELECT fold, date, i, lo FROM nd JOIN fo ON i <= hi)",
    "dc AS (SELECT fold, max(date) AS date, 1 AS dec FROM fd GROUP BY fold, year(date), month(date) HAVING max(i) + 1 >= 42)",
    "dy AS (SELECT fd.fold, fd.date, lo, i, coalesce(dec, 0) AS dec, coalesce(sum(coalesce(dec, 0)) OVER (PARTITION BY fd.fold ORDER BY fd.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS per FROM fd LEFT JOIN dc ON dc.fold = fd.fold AND dc.date = fd.date)",
    "rw AS (SELECT fold, r.date, i, lo, per, dec, weight, product(1 + ret) OVER (PARTITION BY fold, r.ticker, per ORDER BY r.date) AS g FROM r JOIN bk USING (ticker) JOIN dy USING (date) WHERE per > 0)",
    "br AS (SELECT fold, date, i, lo, per, dec, 1 + sum(weight * (g - 1)) AS v FROM rw GROUP BY ALL)",
    "cs AS (SELECT br.fold, br.date, br.i, br.lo, br.per, br.dec, br.v, CASE WHEN br.dec = 1 THEN sum(abs(rw.weight - rw.weight * rw.g / br.v)) * 0.001 ELSE 0 END AS cost FROM br JOIN rw ON rw.date = br.date AND rw.fold = br.fold GROUP BY 1, 2, 3, 4, 5, 6, 7)",
    "en AS (SELECT DISTINCT fold, 0 AS per, 1 - 0.001 AS f FROM fo UNION ALL SELECT fold, per, v * (1 - cost) FROM cs WHERE dec = 1)",
    "ch AS (SELECT fold, per + 1 AS per, product(f) OVER (PARTITION BY fold ORDER BY per) AS base FROM en)",
    "sg AS (SELECT cs.fold, date, base * v * (1 - cost) AS equity FROM cs JOIN ch ON ch.fold = cs.fold AND ch.per = cs.per WHERE i >= lo)",
    "gr AS (SELECT fold, arg_max(equity, date) / arg_min(equity, date) AS g FROM sg GROUP BY fold)",
    "bs AS (SELECT fold, coalesce(product(g) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS base FROM gr)",
]


@query(panels.sql("flag", *_FOLDED, select="SELECT CAST(fold AS BIGINT) AS fold, date, round(base * equity / first_value(equity) OVER (PARTITION BY fold ORDER BY date), 9) AS equity FROM sg JOIN bs USING (fold)"))
def walk_forward_equity(spark, d):
    rows = panels.returns(spark, d, "flag")
    out, _ = walkforward.walk_forward(rows, [strategies.EqualWeight()], _folds(rows), backtest.BacktestConfig(lookback=42, dust=0.0))
    return rounded(out.where("kind = 'equity'").select("fold", "date", "equity"), 9)


@query()
def walk_forward(spark, d):
    rows = panels.returns(spark, d, "flag")
    out, _ = walkforward.walk_forward(rows, [strategies.EqualWeight(), strategies.InverseVolatility(), strategies.Momentum()], _folds(rows), backtest.BacktestConfig(lookback=42))
    return rounded(out.where("kind = 'equity'").select("fold", "run_id", "date", "equity", "ret"))


# ---------------------------------------------------------------- solvers on small matrices


def _matrix(spark, d, name="prio_month", method="sample"):
    rows = panels.returns(spark, d, name)
    tickers = sorted(r[0] for r in rows.select("ticker").distinct().collect())  # the universe
    return rows, tickers, C.estimate(rows, tickers, method)


def _weights(spark, results) -> DataFrame:
    return rounded(spark.createDataFrame([(r.method, t, float(w)) for r in results for t, w in zip(r.tickers, r.weights)], "method string, ticker string, weight double"))


@query()
def optimised_books(spark, d):
    _, tickers, cov = _matrix(spark, d)
    return _weights(spark, [optimizers.min_variance(cov.values, tickers), optimizers.risk_parity(cov.values, tickers), optimizers.hrp(cov.values, tickers)])


_BOX = (0.1, 0.6)
_SIDES = [("xa", "1", "0"), ("xn", "y1", "y0"), ("xr", "-1 - y1", "1 - y0")]  # weights of A, N and R as slope and base of that of A


@query(
    panels.sql(
        "flag", _PAIRS, _COV,
        "k AS (SELECT sum(CASE WHEN a = 'A' AND b = 'A' THEN cov END) AS aa, sum(CASE WHEN a = 'N' AND b = 'N' THEN cov END) AS nn, sum(CASE WHEN a = 'R' AND b = 'R' THEN cov END) AS rr, sum(CASE WHEN a = 'A' AND b = 'N' THEN cov END) AS an, sum(CASE WHEN a = 'A' AND b = 'R' THEN cov END) AS ar, sum(CASE WHEN a = 'N' AND b = 'R' THEN cov END) AS nr FROM cv)",
        "mu AS (SELECT avg(ret) FILTER (WHERE ticker = 'A') AS ma, avg(ret) FILTER (WHERE ticker = 'N') AS mn, avg(ret) FILTER (WHERE ticker = 'R') AS mr FROM r)",
        "en AS (SELECT *, greatest(ma, mn, mr) AS top, least(ma, mn, mr) AS bottom, ma + mn + mr - greatest(ma, mn, mr) - least(ma, mn, mr) AS mid FROM mu)",
        f"tg AS (SELECT *, ({_BOX[1]} * bottom + {1 - _BOX[1] - _BOX[0]:.1f} * mid + {_BOX[0]} * top) AS least_return, ({_BOX[1]} * top + {1 - _BOX[1] - _BOX[0]:.1f} * mid + {_BOX[0]} * bottom) AS most_return FROM en)",
        "ln AS (SELECT *, least_return + (most_return - least_return) * point / 20 AS target FROM tg, range(21) t(point))",
        "pr2 AS (SELECT *, (target - mr) / (mn - mr) AS y0, -(ma - mr) / (mn - mr) AS y1 FROM ln)",
        "iv AS (SELECT *, greatest(" + ", ".join(f"least(({_BOX[0]} - ({b})) / ({s}), ({_BOX[1]} - ({b})) / ({s}))" for _, s, b in _SIDES) + ") AS lo, least(" + ", ".join(f"greatest(({_BOX[0]} - ({b})) / ({s}), ({_BOX[1]} - ({b})) / ({s}))" for _, s, b in _SIDES) + ") AS hi FROM pr2)",
        "vr AS (SELECT *, aa + y1 * y1 * nn + (1 + y1) * (1 + y1) * rr + 2 * y1 * an - 2 * (1 + y1) * ar - 2 * y1 * (1 + y1) * nr AS q2, 2 * y0 * y1 * nn - 2 * (1 - y0) * (1 + y1) * rr + 2 * y0 * an + 2 * (1 - y0) * ar + 2 * (y1 * (1 - y0) - y0 * (1 + y1)) * nr AS q1 FROM iv, k)",
        "sl AS (SELECT *, least(greatest(-q1 / (2 * q2), lo), greatest(hi, lo)) AS xa FROM vr)",
        select='SELECT point, round(target * 1e3, 6) AS target, round(xa, 5) AS "A", round(y0 + y1 * xa, 5) AS "N", round(1 - xa - y0 - y1 * xa, 5) AS "R" FROM sl',
    )
)
def frontier_three_assets(spark, d):
    """Points of the whole frontier within bounds: corner portfolios as a table, points as expressions on it."""
    rows, tickers, cov = _flag_cov(spark, d)
    mu = {r["ticker"]: r["m"] for r in rows.groupBy("ticker").agg(F.avg("ret").alias("m")).collect()}
    segments = optimizers.frontier_segments(cov, np.array([mu[t] for t in tickers]), *_BOX)
    table = spark.createDataFrame(segments, "segment int, from_return double, to_return double, from_variance double, to_variance double, covariance double, from_weights array<double>, to_weights array<double>")
    ends = table.agg(F.min("from_return").alias("lo"), F.max("to_return").alias("hi"))
    targets = spark.range(21).select(F.col("id").alias("point")).crossJoin(F.broadcast(ends)).withColumn("target", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / 20)
    found = optimizers.on_segments(targets, table)
    return rounded(found.select("point", (F.col("target") * 1e3).alias("target"), *[F.round(F.col("weights")[k], 5).alias(t) for k, t in enumerate(tickers)]))


@query()
def efficient_frontier(spark, d):
    rows, tickers, cov = _matrix(spark, d)
    mu = {r["ticker"]: r["m"] for r in rows.groupBy("ticker").agg(F.avg("ret").alias("m")).collect()}
    points = optimizers.efficient_frontier(cov.values, np.array([mu[t] for t in tickers]), tickers, points=20)
    return rounded(spark.createDataFrame([(k, float(p["target"]), float(p["volatility"])) for k, p in enumerate(points)], "point int, target double, volatility double"), 9)


_SHRUNK = [
    "c AS (SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM r)",
    "m AS (SELECT k.ticker AS a, l.ticker AS b, count(*) AS n, avg(k.x * l.x) AS s, avg(k.x * k.x * l.x * l.x) AS q, avg(pow(k.x, 3) * l.x) AS u FROM c k JOIN c l USING (date) GROUP BY 1, 2)",
    "w AS (SELECT m.*, va.s AS va, vb.s AS vb, sqrt(count(*) OVER ()) AS p FROM m JOIN m va ON va.a = m.a AND va.b = m.a JOIN m vb ON vb.a = m.b AND vb.b = m.b)",
    "rb AS (SELECT (sum(s / sqrt(va * vb)) - max(p)) / (max(p) * (max(p) - 1)) AS rbar FROM w)",
    "t AS (SELECT w.*, rbar, CASE WHEN a = b THEN s ELSE rbar * sqrt(va * vb) END AS t FROM w, rb)",
    "dl AS (SELECT least(greatest((sum(q - s * s) - sum(CASE WHEN a = b THEN q - s * s ELSE rbar * (u - va * s) * sqrt(vb / va) END)) / sum(pow(t - s, 2)) / max(n), 0), 1) AS delta FROM t)",
]


@query(panels.sql("prio_month", *_SHRUNK, select="SELECT a, b, round(delta * t + (1 - delta) * s * n / (n - 1), 14) AS cov FROM t, dl"))
def shrunk_covariance(spark, d):
    _, _, cov = _matrix(spark, d, method="constant_correlation")
    return rounded(cov.table(spark), 14)


#: The covariance of the three flags in one row, and that of two of them.
_THREE = "k3 AS (SELECT max(cov) FILTER (WHERE a = 'A' AND b = 'A') AS aa, max(cov) FILTER (WHERE a = 'A' AND b = 'N') AS an, max(cov) FILTER (WHERE a = 'A' AND b = 'R') AS ar, max(cov) FILTER (WHERE a = 'N' AND b = 'N') AS nn, max(cov) FILTER (WHERE a = 'N' AND b = 'R') AS nr, max(cov) FILTER (WHERE a = 'R' AND b = 'R') AS rr FROM cv)"
_SOLVED = "w3 AS (SELECT nn * rr - nr * nr + ar * nr - an * rr + an * nr - ar * nn AS wa, ar * nr - an * rr + aa * rr - ar * ar + an * ar - aa * nr AS wn, an * nr - ar * nn + an * ar - aa * nr + aa * nn - an * an AS wr FROM k3)"


def _flag_cov(spark, d, tickers=("A", "N", "R")):
    rows = panels.returns(spark, d, "flag").where(F.col("ticker").isin(list(tickers)))
    return rows, list(tickers), C.estimate(rows, list(tickers)).values


@query(panels.sql("flag", _PAIRS, _COV, _THREE, _SOLVED, select="SELECT ticker, round(w / (wa + wn + wr), 9) AS weight FROM (SELECT 'A' AS ticker, wa AS w, * FROM w3 UNION ALL SELECT 'N', wn, * FROM w3 UNION ALL SELECT 'R', wr, * FROM w3)"))
def min_variance_weights(spark, d):
    _, tickers, cov = _flag_cov(spark, d)
    best = optimizers.min_variance(cov, tickers, optimizers.LONG_SHORT)
    return rounded(panel.weights_frame(spark.range(1), dict(zip(tickers, best.weights))), 9)


@query("SELECT DISTINCT l_returnflag AS ticker, round(1.0 / 3, 6) AS share FROM lineitem")
def risk_parity_shares(spark, d):
    """The shares of risk of the risk-parity book, which are equal by its definition."""
    rows, tickers, cov = _flag_cov(spark, d)
    book = optimizers.risk_parity(cov, tickers)
    return rounded(C.risk_decomposition(C.covariance(rows), panel.weights_frame(rows, dict(zip(tickers, book.weights)))).select("ticker", "share"))


_EIGEN = "e AS (SELECT *, (aa + nn) / 2 + d AS l1, (aa + nn) / 2 - d AS l2 FROM (SELECT *, sqrt(pow((aa - nn) / 2, 2) + an * an) AS d FROM k3)), v AS (SELECT *, an / h AS x, (l1 - aa) / h AS y FROM (SELECT *, sqrt(an * an + pow(l1 - aa, 2)) AS h FROM e)), z AS (SELECT *, CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS s1, CASE WHEN abs(y) >= abs(x) THEN sign(y) ELSE -sign(x) END AS s2 FROM v)"
_LOADINGS = "lo AS (SELECT 'A' AS ticker, 1 AS component, x * s1 AS loading FROM z UNION ALL SELECT 'N', 1, y * s1 FROM z UNION ALL SELECT 'A', 2, y * s2 FROM z UNION ALL SELECT 'N', 2, -x * s2 FROM z)"


@query(panels.sql("flag", _PAIRS, _COV, _THREE, select="SELECT ticker, round(CASE WHEN ticker = 'A' THEN nn ELSE aa END / (aa + nn), 9) AS weight FROM (VALUES ('A'), ('N')) t(ticker), k3"))
def hrp_two_assets(spark, d):
    _, tickers, cov = _flag_cov(spark, d, ("A", "N"))
    return rounded(panel.weights_frame(spark.range(1), dict(zip(tickers, optimizers.hrp(cov, tickers).weights))), 9)


@query(
    panels.sql(
        "flag", _PAIRS, _COV, _THREE,
        "mu AS (SELECT avg(ret) FILTER (WHERE ticker = 'A') AS ma, avg(ret) FILTER (WHERE ticker = 'N') AS mn FROM r)",
        "b AS (SELECT *, least(greatest((nn - an) / (aa + nn - 2 * an), 0), 1) AS w0 FROM k3, mu)",
        "g AS (SELECT *, w0 * ma + (1 - w0) * mn + (greatest(ma, mn) - (w0 * ma + (1 - w0) * mn)) * point / 9 AS target FROM b, range(10) t(point))",
        "q AS (SELECT *, (target - mn) / (ma - mn) AS w FROM g)",
        select="SELECT point, round(target, 9) AS target, round(sqrt(w * w * aa + 2 * w * (1 - w) * an + (1 - w) * (1 - w) * nn), 9) AS volatility FROM q",
    )
)
def frontier_two_assets(spark, d):
    rows, tickers, cov = _flag_cov(spark, d, ("A", "N"))
    mu = {r["ticker"]: r["m"] for r in rows.groupBy("ticker").agg(F.avg("ret").alias("m")).collect()}
    points = optimizers.efficient_frontier(cov, np.array([mu[t] for t in tickers]), tickers, points=10)
    return rounded(spark.createDataFrame([(k, float(p["target"]), float(p["volatility"])) for k, p in enumerate(points)], "point int, target double, volatility double"), 9)


@query(panels.sql("flag", _PAIRS, _COV, _THREE, _EIGEN, _LOADINGS, select="SELECT ticker, CAST(component AS BIGINT) AS component, round(loading, 6) AS loading FROM lo"))
def components_two_assets(spark, d):
    _, tickers, cov = _flag_cov(spark, d, ("A", "N"))
    return rounded(FA.principal_components(cov, tickers).table(spark))


@query(panels.sql("flag", _PAIRS, _COV, _THREE, _EIGEN, _LOADINGS, "c AS (SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM r)", select="SELECT date, CAST(component AS BIGINT) AS component, round(sum(x * loading), 6) AS score FROM c JOIN lo USING (ticker) GROUP BY date, component"))
def scores_two_assets(spark, d):
    rows, tickers, cov = _flag_cov(spark, d, ("A", "N"))
    return rounded(FA.scores(rows, FA.principal_components(cov, tickers)))


@query(
    panels.sql(
        "flag", _PAIRS, _COV, _THREE, _EIGEN, "sh AS (SELECT l1 * pow((x + y) / 2, 2) AS a, l2 * pow((y - x) / 2, 2) AS b FROM z)", "st AS (SELECT a / (a + b) AS a, b / (a + b) AS b FROM sh)",
        select="SELECT round(exp(-(a * ln(a) + b * ln(b))), 6) AS effective_bets, 2.0 AS effective_positions, round(greatest(a, b), 6) AS top_share FROM st",
    )
)
def concentration_two_assets(spark, d):
    _, tickers, cov = _flag_cov(spark, d, ("A", "N"))
    c = FA.concentration(dict.fromkeys(tickers, 0.5), cov, tickers)
    return rounded(spark.createDataFrame([(float(c["effective_bets"]), float(c["effective_positions"]), float(c["top_share"]))], "effective_bets double, effective_positions double, top_share double"))


@query(panels.sql("flag", _PAIRS, _RHO, select="SELECT a AS source, b AS target, round(sqrt(greatest(2 * (1 - rho), 0)), 6) AS distance, round(rho, 6) AS correlation FROM rho WHERE a < b ORDER BY rho DESC LIMIT 2"))
def spanning_tree_three_assets(spark, d):
    """The tree of three assets: the two shortest of their three distances."""
    rows, tickers, cov = _flag_cov(spark, d)
    return rounded(networks.spanning_tree(numeric.correlation_of(cov), tickers).table(spark))


_WIDE = "w AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS BIGINT) AS ticker, avg(l_extendedprice) / 100000 AS ret FROM lineitem GROUP BY 1, 2)"
_WIDE_COV = "cv AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS cov, count(*) AS n FROM w x JOIN w y ON x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2)"
_RHO = "rh AS (SELECT c.a, c.b, greatest(-1, least(1, c.cov / sqrt(x.cov * y.cov))) AS rho FROM cv c JOIN cv x ON x.a = c.a AND x.b = c.a JOIN cv y ON y.a = c.b AND y.b = c.b WHERE c.a <> c.b)"


def _minimax(steps: int) -> list[str]:
    """The least largest distance on a path between any two, by squaring; an edge of that length is in the tree."""
    out = ["m0 AS (SELECT a, b, sqrt(greatest(2 * (1 - rho), 0)) AS v FROM rh UNION ALL SELECT b, a, sqrt(greatest(2 * (1 - rho), 0)) FROM rh)"]
    for k in range(steps):
        out.append(f"m{k + 1} AS (SELECT x.a, y.b, least(min(greatest(x.v, y.v)), coalesce(min(z.v), 9)) AS v FROM m{k} x JOIN m{k} y ON x.b = y.a AND x.a <> y.b LEFT JOIN m{k} z ON z.a = x.a AND z.b = y.b GROUP BY 1, 2)")
    return out


def _wide(spark, d) -> DataFrame:
    """A universe of as many series as there are suppliers: their monthly mean prices."""
    rows = read_table(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("long").alias("ticker"), "l_extendedprice")
    return staged(rows.groupBy("date", "ticker").agg((F.avg("l_extendedprice") / 100000).alias("ret")), "wide")


@query("WITH " + ",\n".join([_WIDE, _WIDE_COV]) + "\nSELECT a, b, round(cov, 9) AS cov, n FROM cv")
def cov_wide(spark, d):
    return WI.covariances(_wide(spark, d), 9)


@query("WITH " + ",\n".join([_WIDE, _WIDE_COV, _RHO, *_minimax(7)]) + "\nSELECT rh.a, rh.b, round(m0.v, 9) AS distance, round(rho, 9) AS rho FROM rh JOIN m0 USING (a, b) JOIN m7 USING (a, b) WHERE m0.v <= m7.v + 1e-12")
def spanning_tree_wide(spark, d):
    """The pairs of a wide universe that are in some minimum spanning tree."""
    return rounded(WI.spanning_trees(_wide(spark, d)), 9)


@query()
def components_wide(spark, d):
    """Three leading components of a wide universe."""
    tickers, values, loadings = WI.leading_components(_wide(spark, d), 3)
    k = len(values)
    columns = [np.repeat(np.array(tickers, dtype="int64"), k), np.tile(np.arange(1, k + 1), len(tickers)), np.tile(values, len(tickers)), loadings.ravel()]
    return rounded(WI.table(spark, columns, [("ticker", "bigint"), ("component", "int"), ("variance", "double"), ("loading", "double")]), 6)


@query(
    panels.sql(
        "prio_month", "cv AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS cov FROM r x JOIN r y USING (date) GROUP BY 1, 2)", "c2 AS (SELECT x.a, y.b, sum(x.cov * y.cov) AS v FROM cv x JOIN cv y ON x.b = y.a GROUP BY 1, 2)",
        select="SELECT cv.a, cv.b, round(cov * 1e6, 6) AS cov, CAST(cv.a = cv.b AS BIGINT) AS unit, round(v * 1e12, 6) AS square FROM cv JOIN c2 ON c2.a = cv.a AND c2.b = cv.b",
    )
)
def component_identities(spark, d):
    """What makes components those of a covariance: their products with themselves are those of the unit matrix, and weighted by
    their variances and the squares of these those of the covariance and of its square."""
    _, tickers, cov = _matrix(spark, d)
    pca = FA.principal_components(cov.values, tickers)
    loads = pca.table(spark).join(spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(pca.values)], "component int, value double"), "component")
    other = loads.select("component", F.col("ticker").alias("b"), F.col("loading").alias("lb"))
    both = loads.join(other, "component").groupBy(F.col("ticker").alias("a"), "b").agg(
        (F.sum(F.col("value") * F.col("loading") * F.col("lb")) * 1e6).alias("cov"), F.round(F.sum(F.col("loading") * F.col("lb")), 6).cast("long").alias("unit"), (F.sum(F.col("value") * F.col("value") * F.col("loading") * F.col("lb")) * 1e12).alias("square")
    )
    return rounded(both)


@query()
def principal_components(spark, d):
    _, tickers, cov = _matrix(spark, d)
    return rounded(FA.principal_components(cov.values, tickers).table(spark))


@query()
def component_scores(spark, d):
    rows, tickers, cov = _matrix(spark, d)
    return rounded(FA.scores(rows, FA.principal_components(cov.values, tickers)))


@query()
def hidden_concentration(spark, d):
    _, tickers, cov = _matrix(spark, d)
    c = FA.concentration(dict.fromkeys(tickers, 1 / len(tickers)), cov.values, tickers)
    return rounded(spark.createDataFrame([(c["verdict"], float(c["effective_bets"]), float(c["effective_positions"]), float(c["top_share"]))], "verdict string, effective_bets double, effective_positions double, top_share double"))


@query()
def correlation_clusters(spark, d):
    _, tickers, cov = _matrix(spark, d)
    c = networks.clusters(cov.correlation(), tickers)
    return spark.createDataFrame([(t, k, c.labels[t]) for k, t in enumerate(c.order)], "ticker string, place int, cluster int")


@query(
    panels.sql(
        "prio_month", "cv AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS cov FROM r x JOIN r y ON x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2)", _RHO, *_minimax(2),
        select="SELECT rh.a AS source, rh.b AS target, round(m0.v, 6) AS distance, round(rho, 6) AS correlation FROM rh JOIN m0 USING (a, b) JOIN m2 USING (a, b) WHERE m0.v <= m2.v + 1e-12",
    )
)
def spanning_tree(spark, d):
    _, tickers, cov = _matrix(spark, d)
    return rounded(networks.spanning_tree(cov.correlation(), tickers).table(spark))


@query()
def regime_model(spark, d):
    rows = panel.equal_weight_returns(panels.returns(spark, d, "flag")).withColumn("track", F.lit("market"))
    return regimes.fit_regimes(rows, ["track"], restarts=2).select("track", "date", "state", "filtered_state")


def _one_series(spark, d) -> DataFrame:
    """All tracks of a panel behind one another as one long series."""
    rows = panels.returns(spark, d, "flagstat")
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("ticker", "date"))  # one track by construction
    return rows.withColumn("date", F.date_add(F.lit("1990-01-01").cast("date"), place))


@query()
def regime_fit_long(spark, d):
    """One long series, fitted from five starts."""
    return regimes.fit_regime_series(_one_series(spark, d), restarts=5).select(F.lit("all").alias("track"), "date", "state", "filtered_state")


@query()
def regime_fit_spans(spark, d):
    """The same series cut into spans, ten steps from two starts, each step one job over the spans."""
    found = regimes.fit_regime_series(_one_series(spark, d), restarts=2, iterations=10, span_rows=4096)
    return rounded(found.select("date", "state", "filtered_state", F.col("filtered")[0].alias("calm"), "loglik"), 6)


_CALM = (0.0004, 0.003, -0.0006, 0.009, 0.97, 0.08)  # means and deviations of two states, the chances to stay calm and to leave stress
_DENS = [f"exp(-0.5 * pow((x.ret - {m!r}) / {s!r}, 2)) / {s!r}" for m, s in (_CALM[:2], _CALM[2:4])]
_STEP = (f"(pc * {_CALM[4]!r} + (1 - pc) * {_CALM[5]!r})", f"(pc * {1 - _CALM[4]!r} + (1 - pc) * {1 - _CALM[5]!r})")


@query(
    panels.sql(
        "flag", "mk AS (SELECT date, avg(ret) AS ret, row_number() OVER (ORDER BY date) AS i FROM r GROUP BY date)",
        f"""fi AS (
            SELECT x.i, x.date, s * {_DENS[0]} / (s * {_DENS[0]} + (1 - s) * {_DENS[1]}) AS pc, ln((s * {_DENS[0]} + (1 - s) * {_DENS[1]}) / sqrt(2 * pi())) AS ll FROM mk x, (SELECT {_CALM[5]!r} / ({_CALM[5]!r} + 1 - {_CALM[4]!r}) AS s) WHERE x.i = 1
            UNION ALL SELECT x.i, x.date, {_STEP[0]} * {_DENS[0]} / ({_STEP[0]} * {_DENS[0]} + {_STEP[1]} * {_DENS[1]}), ll + ln(({_STEP[0]} * {_DENS[0]} + {_STEP[1]} * {_DENS[1]}) / sqrt(2 * pi())) FROM fi JOIN mk x ON x.i = fi.i + 1)""",
        select="SELECT date, round(pc, 6) AS calm, round((SELECT max_by(ll, i) FROM fi), 4) AS loglik FROM fi",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def regime_filter(spark, d):
    """A given model's filtered probabilities and log-likelihood of a market's returns, by a scan over spans."""
    m0, s0, m1, s1, stay, leave = _CALM
    market = panel.equal_weight_returns(panels.returns(spark, d, "flag"))
    found = regimes.filter_series(market, [m0, m1], [s0, s1], [[stay, 1 - stay], [leave, 1 - leave]], span_rows=300)
    return found.select("date", F.round(F.col("filtered")[0], 6).alias("calm"), F.round("loglik", 4).alias("loglik"))


@query()
def tail_comparison(spark, d):
    return rounded(C.tail_comparison(panels.returns(spark, d, "flag"), ["ticker"]))


_EMPTY_FITS = "u AS (SELECT ticker, quantile_cont(-ret, 0.95) AS u, count(*) AS n FROM r GROUP BY ticker)"


@query(panels.sql("flag", _EMPTY_FITS, select="SELECT r.ticker, round(max(u), 9) AS threshold, max(n) AS n, count(*) AS exceedances FROM r JOIN u USING (ticker) WHERE -ret > u GROUP BY r.ticker"))
def evt_exceedances(spark, d):
    return rounded(C.evt_tail(panels.returns(spark, d, "flag"), ["ticker"]).select("ticker", "threshold", "n", "exceedances"), 9)


@query()
def evt_tail(spark, d):
    return rounded(C.evt_tail(panels.returns(spark, d, "flag"), ["ticker"]))


@query(
    panels.sql(
        "flag", _XY,
        "q AS (SELECT date, count(*) OVER w AS n, avg(y) OVER w AS my, avg(f) OVER w AS mf, avg(h) OVER w AS mh, var_pop(f) OVER w AS sff, var_pop(h) OVER w AS shh, var_pop(y) OVER w AS syy, covar_pop(f, h) OVER w AS sfh, covar_pop(f, y) OVER w AS sfy, covar_pop(h, y) OVER w AS shy FROM xy WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))",
        "b AS (SELECT *, (sfy * shh - shy * sfh) / (sff * shh - sfh * sfh) AS bf, (shy * sff - sfy * sfh) / (sff * shh - sfh * sfh) AS bh FROM q WHERE n = 252)",
        select='SELECT date, round(my - bf * mf - bh * mh, 6) AS alpha, round(bf, 6) AS "N", round(bh, 6) AS "R", round((bf * sfy + bh * shy) / syy, 6) AS r_squared FROM b',
    )
)
def rolling_factor_betas(spark, d):
    wide = panel.to_wide(panels.returns(spark, d, "flag"), sorted(FLAG_BOOK), "ret")
    rows = wide.select("date", F.col("A").alias("ret"), "N", "R").dropna()
    return rounded(FA.rolling_betas(FA.AlignedFactors(rows, ("N", "R"), 0)))
