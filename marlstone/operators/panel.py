"""Panels of prices and returns in long form: alignment by intersection, returns, portfolios, schedules, upserts.

A panel has the columns (date, ticker, <value>). Nothing is ever filled forward: assets are aligned on the dates that all
of them have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions.calendar import Calendar


def intersect_dates(panel: DataFrame, tickers: Sequence[str] | None = None, value: str = "price") -> DataFrame:
    """Rows of the dates on which every ticker has a value.

    One aggregation by date replaces a chain of outer joins. Without ``tickers`` the panel's own distinct ones count.
    """
    rows = panel.where(F.col(value).isNotNull())
    if tickers is not None:
        rows = rows.where(F.col("ticker").isin(list(tickers)))
        need = F.lit(len(set(tickers)))
        full = rows.groupBy("date").agg(F.count_distinct("ticker").alias("n")).where(F.col("n") == need)
    else:
        total = rows.agg(F.count_distinct("ticker").alias("need"))  # one row
        full = rows.groupBy("date").agg(F.count_distinct("ticker").alias("n")).join(F.broadcast(total), F.col("n") == F.col("need"))
    return rows.join(full.select("date"), "date", "left_semi")


def _previous(value: str) -> Column:
    return F.lag(value).over(W.partitionBy("ticker").orderBy("date"))


def simple_returns(panel: DataFrame, value: str = "price") -> DataFrame:
    """(date, ticker, ret): p(t) / p(t-1) - 1, without each ticker's first date."""
    return panel.withColumn("__p", _previous(value)).where(F.col("__p").isNotNull()).select("date", "ticker", (F.col(value) / F.col("__p") - 1).alias("ret"))


def log_returns(panel: DataFrame, value: str = "price") -> DataFrame:
    """(date, ticker, ret): ln(p(t) / p(t-1)), without each ticker's first date."""
    return panel.withColumn("__p", _previous(value)).where(F.col("__p").isNotNull()).select("date", "ticker", F.log(F.col(value) / F.col("__p")).alias("ret"))


@dataclass(frozen=True)
class ReturnSeries:
    """A long panel of returns with what its users must not lose: tickers, kind and calendar."""

    data: DataFrame
    tickers: tuple[str, ...]
    is_log: bool = False
    calendar: Calendar = Calendar.TRADING_DAYS

    def __post_init__(self):
        missing = {"date", "ticker", "ret"} - set(self.data.columns)
        if missing:
            raise ValueError(f"a return series lacks {sorted(missing)}")
        if not self.tickers:
            raise ValueError("a return series needs tickers")

    @staticmethod
    def from_prices(panel: DataFrame, tickers: Sequence[str], value: str = "price", kind: str = "simple", calendar: Calendar = Calendar.TRADING_DAYS) -> "ReturnSeries":
        if kind not in ("simple", "log"):
            raise ValueError(f"unknown kind {kind!r}")
        make = log_returns if kind == "log" else simple_returns
        return ReturnSeries(make(intersect_dates(panel, tickers, value), value), tuple(tickers), kind == "log", calendar)

    @property
    def periods_per_year(self) -> int:
        return self.calendar.periods_per_year

    @property
    def n_assets(self) -> int:
        return len(self.tickers)

    def n_obs(self) -> int:
        return self.data.select("date").distinct().count()

    def select(self, tickers: Sequence[str]) -> "ReturnSeries":
        unknown = set(tickers) - set(self.tickers)
        if unknown:
            raise KeyError(f"unknown tickers {sorted(unknown)}")
        return ReturnSeries(self.data.where(F.col("ticker").isin(list(tickers))), tuple(tickers), self.is_log, self.calendar)

    def trim(self, start=None, end=None) -> "ReturnSeries":
        """Inclusive date range."""
        rows = self.data
        if start is not None:
            rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
        return ReturnSeries(rows, self.tickers, self.is_log, self.calendar)

    def portfolio(self, weights: dict[str, float]) -> DataFrame:
        return portfolio_returns(self.data, weights)

    def wide(self) -> DataFrame:
        return to_wide(self.data, list(self.tickers), "ret")


def weights_frame(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A (ticker, weight) table of the given book."""
    return panel.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "ticker string, weight double")


def portfolio_returns(returns: DataFrame, weights: dict[str, float] | DataFrame) -> DataFrame:
    """(date, ret): the weighted sum of the tickers' returns; tickers without a weight don't count."""
    book = weights_frame(returns, weights) if isinstance(weights, dict) else weights
    return returns.join(F.broadcast(book), "ticker").groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def equal_weight_returns(returns: DataFrame) -> DataFrame:
    return returns.groupBy("date").agg(F.avg("ret").alias("ret"))


def to_wide(panel: DataFrame, tickers: Sequence[str], value: str) -> DataFrame:
    """One column for each ticker, by date; only for the edges of the system."""
    return panel.groupBy("date").pivot("ticker", list(tickers)).agg(F.first(value)).orderBy("date")


def to_long(wide: DataFrame, value: str, variable: str = "ticker", ids: Sequence[str] = ("date",)) -> DataFrame:
    """One row for each value that is there, of the columns that are no ``ids``."""
    return wide.unpivot(list(ids), [c for c in wide.columns if c not in ids], variable, value).where(F.col(value).isNotNull())


def drop_empty_rows(rows: DataFrame) -> DataFrame:
    """Without rows whose columns other than the date are all null."""
    return rows.dropna("all", subset=[c for c in rows.columns if c != "date"])


def positive(rows: DataFrame, column: str = "adj_close") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.col(column) > 0))


def excess(returns: DataFrame, periods_per_year: int, rate: float | DataFrame = 0.04) -> DataFrame:
    """(…, excess): returns less a yearly rate, or less a daily series (date, rf) on the dates that both have."""
    if isinstance(rate, DataFrame):
        return returns.join(rate, "date").withColumn("excess", F.col("ret") - F.col("rf"))
    return returns.withColumn("excess", F.col("ret") - F.lit(rate / periods_per_year))


PERIOD_KEYS = {
    "daily": lambda d: d.cast("string"),
    "weekly": lambda d: F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)),
    "monthly": lambda d: F.date_format(d, "yyyy-MM"),
    "quarterly": lambda d: F.concat_ws("-", F.year(d), F.quarter(d)),
    "annual": lambda d: F.year(d).cast("string"),
}


def schedule(dates: DataFrame, frequency: str, by: Sequence[str] = ()) -> DataFrame:
    """The last observed date of each period: (date), or (by…, date). ISO weeks; the last, partial period counts."""
    if frequency not in PERIOD_KEYS:
        raise ValueError(f"unknown frequency {frequency!r}; one of {sorted(PERIOD_KEYS)}")
    key = PERIOD_KEYS[frequency](F.col("date"))
    return dates.groupBy(*by, key.alias("__period")).agg(F.max("date").alias("date")).drop("__period")


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last by ``order``."""
    window = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order`` (columns or expressions)."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Existing and new rows with one row for each key: new ones win, and of several new ones the last by the columns ``order``
    of ``new``. Rows of a table have no order of their own, so what ``order`` leaves open is settled by the greatest of the
    rows' other values: the result doesn't depend on partitions."""
    columns = [*existing.columns, *[c for c in new.columns if c not in existing.columns]]
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["__new", *order, *[c for c in columns if c not in keys and c not in order]]).select(*columns)


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], lag_days: int = 0, split: str | None = None) -> DataFrame:
    """For each left row the right values of the last time at or before its own time less a lag.

    Both sides meet in one shuffle by key and a running last value, instead of a product of rows in range. A key with very
    many rows can be split by a unit of time (``split``: "month", "day", …): each span of a key is then a task's work of its
    own, and starts from the last value before it, which comes from one aggregate row for each span.
    """
    struct = right.select(F.struct(*values)).schema[0].dataType
    a = left.withColumns({"__t": F.date_sub(F.col(left_time), lag_days) if lag_days else F.col(left_time), "__side": F.lit(1), "__v": F.lit(None).cast(struct), "__row": F.struct(*left.columns)})
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    both = a.select(*by, "__t", "__side", "__v", "__row").unionByName(b.select(*by, "__t", "__side", "__v", "__row"))
    keys = list(by)
    if split:
        both = both.withColumn("__span", F.date_trunc(split, "__t"))
        ends = both.groupBy(*by, "__span").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.struct("__t", "__v"))).alias("__v"))
        before = W.partitionBy(*by).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
        opening = ends.withColumn("__v", F.last("__v", ignorenulls=True).over(before)).where("__v is not null")
        opening = opening.select(*by, F.lit(None).cast(both.schema["__t"].dataType).alias("__t"), F.lit(-1).alias("__side"), "__v", F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), "__span")
        both, keys = both.unionByName(opening), [*by, "__span"]
    window = W.partitionBy(*keys).orderBy(F.asc_nulls_first("__t"), "__side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("__last", F.last("__v", ignorenulls=True).over(window)).where("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def within_ranges(rows: DataFrame, ranges: DataFrame, start: str, end: str, date: str = "date", how: str = "inner") -> DataFrame:
    """Range join to a table of windows, such as folds or scenarios. Spark broadcasts it where it is small, as windows are."""
    return rows.join(ranges, (F.col(date) >= F.col(start)) & (F.col(date) <= F.col(end)), how)
