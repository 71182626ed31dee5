"""Panels derived from the driver's tables, in Spark and as DuckDB SQL. Returns are scaled by 1/100, as daily averages of
single orders swing widely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.panel import intersect_dates, simple_returns
from marlstone.session import read_table

#: name: (table, date expression, ticker expression, value), the expressions valid in both dialects.
PANELS = {
    "flag": ("lineitem", "CAST(l_shipdate AS DATE)", "l_returnflag", "l_extendedprice"),
    "flagstat": ("lineitem", "CAST(l_shipdate AS DATE)", "CONCAT(l_returnflag, l_linestatus)", "l_extendedprice"),
    "prio_day": ("orders", "CAST(o_orderdate AS DATE)", "o_orderpriority", "o_totalprice"),
    "prio_month": ("orders", "CAST(DATE_TRUNC('month', o_orderdate) AS DATE)", "o_orderpriority", "o_totalprice"),
    "event_day": ("events", "CAST(ts AS DATE)", "event_type", "value"),
}
SCALE = 100.0


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(date, ticker, price), without alignment."""
    table, date, ticker, value = PANELS[name]
    rows = read_table(spark, sf_dir, table).select(F.expr(date).alias("date"), F.expr(ticker).alias("ticker"), F.col(value).alias("v"))
    return rows.groupBy("date", "ticker").agg(F.avg("v").alias("price"))


def aligned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return intersect_dates(panel(spark, sf_dir, name))


def returns(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(date, ticker, ret) on the dates that all tickers have."""
    return simple_returns(aligned(spark, sf_dir, name)).withColumn("ret", F.col("ret") / SCALE)


def sql(name: str, *more: str, select: str) -> str:
    """The same as DuckDB SQL: common tables p (panel), a (aligned), r (returns), then ``more`` and the query."""
    table, date, ticker, value = PANELS[name]
    parts = [
        f"p AS (SELECT {date} AS date, {ticker} AS ticker, avg({value}) AS price FROM {table} GROUP BY 1, 2)",
        "ok AS (SELECT date FROM p GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM p))",
        "a AS (SELECT p.* FROM p JOIN ok USING (date))",
        f"r AS (SELECT date, ticker, (price / prev - 1) / {SCALE} AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM a) WHERE prev IS NOT NULL)",
        *more,
    ]
    return "WITH " + ",\n".join(parts) + "\n" + select
