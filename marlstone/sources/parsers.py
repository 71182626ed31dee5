"""Readers of the providers' files: each returns a DataFrame in the store's schema; nothing touches a network."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.operators.panel import keep_last

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume"]


def _lines(spark: SparkSession, text: str, column: str = "line") -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(text.splitlines())], f"n long, {column} string")


def fred_csv(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """(date, value): the first column is the date and the second the value, whatever they are called; '.' is missing."""
    if text is not None:
        lines = _lines(spark, text).where("n > 0")
        parts = lines.select(F.split("line", ",").alias("p")).select(F.get("p", F.lit(0)).alias("d"), F.get("p", F.lit(1)).alias("v"))
    else:
        raw = spark.read.csv(path, header=True)
        parts = raw.select(F.col(f"`{raw.columns[0]}`").alias("d"), F.col(f"`{raw.columns[1]}`").alias("v"))
    return parts.select(F.expr("try_cast(trim(d) AS DATE)").alias("date"), F.expr("try_cast(nullif(trim(v), '.') AS DOUBLE)").alias("value")).dropna().orderBy("date")


def ecb_csv(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """(date, value) of TIME_PERIOD and OBS_VALUE, of a file or of a text."""
    if text is not None:
        head, *rows = csv.reader(io.StringIO(text))
        raw = spark.createDataFrame([tuple(r) for r in rows if len(r) == len(head)], ", ".join(f"`{c}` string" for c in head))
    else:
        raw = spark.read.csv(path, header=True)
    return raw.select(F.expr("try_cast(TIME_PERIOD AS DATE)").alias("date"), F.expr("try_cast(OBS_VALUE AS DOUBLE)").alias("value")).dropna().orderBy("date")


def ecb_key(code: str) -> tuple[str, str]:
    """The dataflow and the series key of a code."""
    flow, _, key = code.partition(".")
    return flow, key


def french_text(spark: SparkSession, text: str, source: str = "french") -> DataFrame:
    """(date, factor, value, source) of the file's first daily block, percent turned into decimals.

    The block starts at the first line that begins with eight digits and a comma and ends before the next one that doesn't;
    the header is the nearest line above it that isn't empty. What isn't a number becomes null and is left out.
    """
    lines = _lines(spark, text).withColumn("daily", F.col("line").rlike(r"^\s*\d{8}\s*,"))
    first = lines.where("daily").agg(F.min("n")).head()[0]
    if first is None:
        raise ValueError("no daily rows in the file")
    head = lines.where((F.col("n") < first) & (F.trim("line") != "")).agg(F.max_by("line", "n")).head()[0] or ""
    names = [c.strip() for c in head.split(",")][1:]
    end = lines.where((F.col("n") > first) & ~F.col("daily")).agg(F.min("n")).head()[0]
    block = lines.where((F.col("n") >= first) & (F.col("n") < (end if end is not None else 2**62)))
    cells = block.select(F.to_date(F.trim(F.substring_index("line", ",", 1)), "yyyyMMdd").alias("date"), F.posexplode(F.slice(F.split("line", ","), 2, len(names))).alias("k", "cell"))
    named = cells.select("date", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1).alias("factor"), (F.expr("try_cast(trim(cell) AS DOUBLE)") / 100).alias("value"))
    return named.where("factor <> '' and value is not null").withColumn("source", F.lit(source)).orderBy("date", "factor")


def french_zip(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The same from the archive it comes in, which is read through Spark."""
    content = spark.read.format("binaryFile").load(path).select("content").head()[0]  # one small archive
    return french_archive(spark, bytes(content), source)


def french_archive(spark: SparkSession, content: bytes, source: str) -> DataFrame:
    """The same from the archive's bytes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return french_text(spark, z.read(z.namelist()[0]).decode("latin-1"), source)


def ohlcv(raw: DataFrame, ticker: str) -> DataFrame:
    """Price rows from a table with a provider's names: lower case, blanks to underscores, dates without time, known columns
    in order, by date. Without an adjusted close the close stands in."""
    named = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    if "adj_close" not in named.columns:
        named = named.withColumn("adj_close", F.col("close"))
    kept = [c for c in PRICE_COLUMNS if c in named.columns]
    return named.select(F.col("date").cast("date").alias("date"), F.lit(ticker).alias("ticker"), *[F.col(c).cast("double").alias(c) for c in kept]).orderBy("date")


def exchange_candles(raw: DataFrame, ticker: str, end: str | None = None) -> DataFrame:
    """Price rows from candles (ts in epoch milliseconds, open, high, low, close, volume): one row for each date, the last
    that was read; the adjusted close is the close. Rows after ``end`` are cut."""
    rows = raw.withColumns({"date": F.to_date(F.timestamp_millis("ts")), "ticker": F.lit(ticker), "adj_close": F.col("close"), "__seq": F.monotonically_increasing_id()})
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return keep_last(rows, ["date"], ["ts", "__seq"]).select("date", "ticker", *PRICE_COLUMNS).orderBy("date")


def paginate(fetch, since: int, limit: int = 1000, until: int | None = None) -> list[list]:
    """Candles of a paged source: stops at a short page, at a page that doesn't advance, or past ``until``."""
    out: list[list] = []
    while page := fetch(since, limit):
        out += [c for c in page if until is None or c[0] <= until]
        last = page[-1][0]
        if len(page) < limit or last < since or (until is not None and last >= until):
            break
        since = last + 1
    return out
