"""Data quality: every check of every ticker as one plan of findings (ticker, check, severity, n, message, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions.calendar import Calendar
from marlstone.operators.performance import runs

INFO, WARNING, CRITICAL = "info", "warning", "critical"

# Daily moves from which a return is suspicious, and from which it is critical, by asset class.
OUTLIER_BANDS = {
    "fixed_income": (0.05, 0.12),
    "equity": (0.20, 0.40),
    "commodity": (0.20, 0.50),
    "fx": (0.08, 0.20),
    "crypto": (0.40, 0.80),
    "alternative": (0.25, 0.50),
    "unknown": (0.25, 0.50),
}
MAD_MULTIPLE, MAD_SCALE = 8.0, 1.4826
SHOWN = 5


def _finding(rows: DataFrame, check: str, severity, n, message, detail) -> DataFrame:
    return rows.select("ticker", F.lit(check).alias("check"), severity.alias("severity"), n.cast("long").alias("n"), message.alias("message"), detail.alias("detail"))


def missing_values(prices: DataFrame, value: str = "adj_close") -> DataFrame:
    """Nulls and non-positive prices, each critical."""
    counts = prices.groupBy("ticker").agg(F.count_if(F.col(value).isNull()).alias("nulls"), F.count_if(F.col(value) <= 0).alias("low"))
    out = None
    for column, check, what in (("nulls", "missing_values", "null"), ("low", "non_positive", "non-positive")):
        n = F.col(column)
        part = _finding(counts.where(n > 0), check, F.lit(CRITICAL), n, F.concat(n.cast("string"), F.lit(f" {what} {value} values")), F.to_json(F.struct(n.alias("count"))))
        out = part if out is None else out.unionByName(part)
    return out


def short_history(prices: DataFrame, min_obs: int = 252) -> DataFrame:
    """Fewer rows than a year's worth, scaled by the ticker's calendar."""
    need = F.when(F.col("calendar") == "continuous", F.lit(round(min_obs * 365 / 252))).otherwise(F.lit(min_obs))
    counts = prices.groupBy("ticker", "calendar").agg(F.count(F.lit(1)).alias("n_obs")).withColumn("need", need).where("n_obs < need")
    return _finding(counts, "short_history", F.lit(WARNING), F.col("n_obs"), F.format_string("history of %d rows where %d are needed", F.col("n_obs"), F.col("need")), F.to_json(F.struct("n_obs", F.col("need").alias("min_obs"))))


def _band(which: int):
    out = F.lit(OUTLIER_BANDS["unknown"][which])
    for name, band in OUTLIER_BANDS.items():
        out = F.when(F.lower("asset_class") == name, F.lit(band[which])).otherwise(out)
    return out


def outlier_events(prices: DataFrame, value: str = "adj_close") -> DataFrame:
    """(ticker, asset_class, date, ret, severity) of suspicious returns: beyond the class's band, or far from the median by
    the scaled median deviation. Tickers with fewer than 3 prices have none."""
    track = W.partitionBy("ticker").orderBy("date")
    usable = prices.where(F.col(value) > 0)
    rets = usable.withColumn("ret", F.col(value) / F.lag(value).over(track) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("ticker")))
    rets = rets.where(F.col("ret").isNotNull() & (F.col("__n") >= 3)).select("ticker", "asset_class", "date", "ret")
    whole = W.partitionBy("ticker")  # the partitions of the returns: no further shuffle
    joined = rets.withColumn("__m", F.median("ret").over(whole))
    joined = joined.withColumn("__mad", F.median(F.abs(F.col("ret") - F.col("__m"))).over(whole)).withColumns({"__warn": _band(0), "__crit": _band(1)})
    far = (F.col("__mad") > 0) & (F.abs(F.col("ret") - F.col("__m")) > MAD_MULTIPLE * MAD_SCALE * F.col("__mad"))
    severity = F.when(F.abs("ret") > F.col("__crit"), F.lit(CRITICAL)).otherwise(F.lit(WARNING))
    return joined.where((F.abs("ret") > F.col("__warn")) | far).select("ticker", "asset_class", "date", "ret", severity.alias("severity"))


def return_outliers(prices: DataFrame, value: str = "adj_close") -> DataFrame:
    """One finding for each ticker with outliers: all events, worst first."""
    events = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.abs("ret").alias("size"), "date", "ret")))), lambda e: F.struct(e["date"].alias("date"), e["ret"].alias("return")))
    rows = outlier_events(prices, value).groupBy("ticker").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("severity") == CRITICAL).alias("bad"), events.alias("events"))
    worst = F.get("events", F.lit(0))
    return _finding(rows, "return_outliers", F.when(F.col("bad"), CRITICAL).otherwise(F.lit(WARNING)), F.col("k"), F.format_string("%d suspicious returns, worst %.1f%% on %s", F.col("k"), worst["return"] * 100, worst["date"].cast("string")), F.to_json(F.struct("events")))


def stale_prices(prices: DataFrame, min_run: int = 5, value: str = "adj_close") -> DataFrame:
    """Runs of at least ``min_run`` equal prices."""
    same = F.col(value) == F.lag(value).over(W.partitionBy("ticker").orderBy("date"))
    longest = runs(prices.withColumn("__same", same), F.col("__same"), ["ticker"]).groupBy("ticker").agg((F.max("length") + 1).alias("longest")).where(F.col("longest") >= min_run)
    return _finding(longest, "stale_prices", F.lit(WARNING), F.col("longest"), F.format_string("the same price on %d days in a row", F.col("longest")), F.to_json(F.struct(F.col("longest").alias("longest_run"))))


def missing_dates(prices: DataFrame) -> DataFrame:
    """(ticker, calendar, date): dates of the ticker's calendar panel that it lacks. One panel for each calendar."""
    dates = prices.select("calendar", "date").distinct()
    tickers = prices.select("calendar", "ticker").distinct()
    return dates.join(tickers, "calendar").join(prices.select("ticker", "date"), ["ticker", "date"], "left_anti")


def calendar_gaps(prices: DataFrame) -> DataFrame:
    rows = missing_dates(prices).groupBy("ticker", "calendar").agg(F.count(F.lit(1)).alias("k"), F.slice(F.array_sort(F.collect_list("date")), 1, SHOWN).alias("sample"))
    return _finding(rows, "calendar_gaps", F.when(F.col("k") > 5, WARNING).otherwise(F.lit(INFO)), F.col("k"), F.format_string("%d panel dates missing (panel: %s assets)", "k", "calendar"), F.to_json(F.struct(F.col("k").alias("count"), "sample", "calendar")))


def gap_events(prices: DataFrame) -> DataFrame:
    """(ticker, calendar, from, to, days): steps between dates that are longer than the calendar makes normal."""
    limit = F.when(F.col("calendar") == "continuous", F.lit(Calendar.CONTINUOUS.max_gap_days)).otherwise(F.lit(Calendar.TRADING_DAYS.max_gap_days))
    rows = prices.withColumn("from", F.lag("date").over(W.partitionBy("ticker").orderBy("date"))).withColumn("days", F.datediff("date", "from"))
    return rows.where(F.col("days") > limit).select("ticker", "calendar", "from", F.col("date").alias("to"), "days")


def observation_gaps(prices: DataFrame) -> DataFrame:
    worst_first = F.reverse(F.array_sort(F.collect_list(F.struct("days", "from", "to"))))
    rows = gap_events(prices).groupBy("ticker", "calendar").agg(F.count(F.lit(1)).alias("k"), F.max("days").alias("worst"), worst_first.alias("gaps"))
    return _finding(rows, "observation_gaps", F.when(F.col("calendar") == "continuous", WARNING).otherwise(F.lit(INFO)), F.col("k"), F.format_string("%d gaps, worst %d days, for a %s asset", "k", "worst", "calendar"), F.to_json(F.struct(F.col("k").alias("count"), "calendar", "gaps")))


def report(prices: DataFrame, value: str = "adj_close", min_obs: int = 252, min_run: int = 5) -> DataFrame:
    """All findings, critical ones first, then by ticker. ``prices``: date, ticker, calendar, asset_class and the value."""
    parts = [missing_values(prices, value), short_history(prices, min_obs), return_outliers(prices, value), stale_prices(prices, min_run, value), calendar_gaps(prices), observation_gaps(prices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("severity") != CRITICAL, "ticker", "check")


def summary(findings: DataFrame) -> DataFrame:
    """n_critical, n_warning and the sorted critical tickers, in one row."""
    return findings.agg(F.count_if(F.col("severity") == CRITICAL).alias("n_critical"), F.count_if(F.col("severity") == WARNING).alias("n_warning"), F.array_sort(F.collect_set(F.when(F.col("severity") == CRITICAL, F.col("ticker")))).alias("critical_tickers"))


def clean_tickers(prices: DataFrame, findings: DataFrame) -> DataFrame:
    """Tickers without a critical finding."""
    return prices.select("ticker").distinct().join(findings.where(F.col("severity") == CRITICAL).select("ticker"), "ticker", "left_anti").orderBy("ticker")
