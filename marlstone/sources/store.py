"""The store: Parquet tables in parts behind pointers, upserts that keep the last row of a key, and SQL over them."""

from __future__ import annotations

import json
import logging
import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.calendar import Calendar, resolve
from marlstone.operators.panel import ReturnSeries, to_wide, upserted

log = logging.getLogger(__name__)

PRICES = "date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adj_close DOUBLE, volume DOUBLE"
RATES = "date DATE, series_id STRING, value DOUBLE, currency STRING, source STRING"
FACTORS = "date DATE, factor STRING, value DOUBLE, source STRING"
ASSETS = "ticker STRING, calendar STRING, asset_class STRING, source STRING"
TABLES = {"prices": (PRICES, ["ticker", "date"]), "rates": (RATES, ["date", "series_id"]), "factors": (FACTORS, ["date", "factor"]), "assets": (ASSETS, ["ticker"])}


def scratch_store(spark: SparkSession) -> "Store":
    """A store of its own under the shared checkpoint folder (in a local session without one, a temporary folder)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="marlstone-store-")
    store = Store(spark, f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}")
    fs, path = store._fs()
    fs.mkdirs(path(store.base))
    fs.deleteOnExit(path(store.base))
    return store


def table_function(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Make ``rows`` a table function of Spark SQL: SELECT ... FROM name()."""
    view = f"__{name}"
    rows.createOrReplaceTempView(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE({columns}) RETURN SELECT {', '.join(f'`{c}`' for c in rows.columns)} FROM {view}")


class Store:
    """Tables under one base path, which any file system of Spark's can hold.

    A table is a set of parts (one for each ticker of the prices, one for other tables), each a folder of Parquet files that
    never changes. A write puts a new part beside the old one and then a new pointer file, whose number is one higher and
    which lists the parts that count. Readers take the highest whole pointer, so they and retried tasks never see half a
    table, and a crash between the steps leaves the table as it was. Two writers can't take the same number: the later one
    starts from the other's pointer. A ticker's scan opens its own files only.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # -------------------------------------------------------- tables

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self, name: str) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.base}/{name}/pointers")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def parts(self, name: str) -> dict[str, str]:
        """The folder of each part by the highest pointer that is whole; none without a table."""
        for number in reversed(self._pointers(name)):
            text = "".join(r[0] for r in self.spark.read.text(f"{self.base}/{name}/pointers/{number:08d}", wholetext=True).collect())
            try:
                return json.loads(text)
            except json.JSONDecodeError:
                continue  # still being written, or left by a writer that died
        return {}

    def _point(self, name: str, changed: dict[str, str]) -> None:
        """A new pointer: the parts there are with the changed ones in their places."""
        fs, path = self._fs()
        while True:
            number = max(self._pointers(name), default=0) + 1  # before the parts are read: who writes meanwhile takes it
            text = json.dumps(self.parts(name) | changed)
            target = path(f"{self.base}/{name}/pointers/{number:08d}")
            try:
                out = fs.create(target, False)
            except Py4JJavaError:
                if fs.exists(target):
                    continue  # another writer was faster
                raise
            out.write(bytearray(text.encode()))
            out.close()
            return

    def exists(self, name: str) -> bool:
        return bool(self.parts(name))

    def table(self, name: str, only: Sequence[str] | None = None) -> DataFrame:
        """The whole table, or only some of its parts."""
        schema = TABLES[name][0]
        parts = self.parts(name)
        folders = [f"{self.base}/{name}/{f}" for p, f in sorted(parts.items()) if only is None or p in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _replace(self, rows: DataFrame, name: str, part: str = "all") -> None:
        """Write a part anew and point to it."""
        folder = f"data/{quote(part, safe='')}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.base}/{name}/{folder}")
        self._point(name, {part: folder})

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` pointers lists, and older pointers; the number of folders deleted."""
        fs, path = self._fs()
        numbers = self._pointers(name)
        used = set()
        for number in numbers[-keep:]:
            used |= set(json.loads("".join(r[0] for r in self.spark.read.text(f"{self.base}/{name}/pointers/{number:08d}", wholetext=True).collect()) or "{}").values())
        for number in numbers[:-keep]:
            fs.delete(path(f"{self.base}/{name}/pointers/{number:08d}"), False)
        gone = [s.getPath() for s in fs.listStatus(path(f"{self.base}/{name}/data")) if f"data/{s.getPath().getName()}" not in used]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    # -------------------------------------------------------- writes

    def write_prices(self, ticker: str, rows: DataFrame, upsert: bool = True) -> int:
        """Rows of one ticker; with ``upsert`` merged by date with what is there, the new rows winning. Returns its rows."""
        rows = rows.withColumn("ticker", F.lit(ticker))
        if upsert:
            rows = upserted(self.table("prices", [ticker]), rows, ["ticker", "date"])
        columns = [f.name for f in self.table("prices", []).schema.fields]
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns])
        self._replace(rows.repartition(1).sortWithinPartitions("date"), "prices", ticker)
        return self.table("prices", [ticker]).count()

    def write_series(self, rows: DataFrame, name: str, keys: Sequence[str] | None = None, upsert: bool = True) -> int:
        keys = list(keys or TABLES[name][1])
        if upsert:
            rows = upserted(self.table(name), rows, keys)
        self._replace(rows.select(*[f.name for f in self.table(name).schema.fields]), name)
        return self.table(name).count()

    def write_asset(self, ticker: str, calendar: str, asset_class: str, source: str) -> None:
        self.write_series(self.spark.createDataFrame([(ticker, calendar, asset_class, source)], ASSETS), "assets")

    # -------------------------------------------------------- reads

    def _between(self, rows: DataFrame, start, end) -> DataFrame:
        if start is not None:
            rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
        return rows

    def prices_long(self, tickers: Sequence[str], start=None, end=None, column: str = "adj_close") -> DataFrame:
        """(date, ticker, price); tickers without data are reported and left out."""
        known = set(self.available_tickers())
        for t in tickers:
            if t not in known:
                log.warning("no prices of %s", t)
        rows = self._between(self.table("prices", list(tickers)), start, end)
        return rows.select("date", "ticker", F.col(column).alias("price"))

    def read_prices(self, tickers: Sequence[str], start=None, end=None, column: str = "adj_close") -> DataFrame:
        known = [t for t in tickers if t in set(self.available_tickers())]
        return to_wide(self.prices_long(tickers, start, end, column), known, "price")

    def read_returns(self, tickers: Sequence[str], start=None, end=None, kind: str = "simple") -> ReturnSeries:
        """Returns on the dates that all known tickers have; the calendar is the mix's most restrictive."""
        known = [t for t in tickers if t in set(self.available_tickers())]
        if not known:
            raise ValueError(f"no prices of any of {list(tickers)}")
        meta = self.assets()
        calendar = resolve(Calendar.parse(meta.get(t, {}).get("calendar")) for t in known)
        out = ReturnSeries.from_prices(self.prices_long(known, start, end), known, "price", kind, calendar)
        if out.data.isEmpty():
            raise ValueError(f"{known} share no dates")
        return out

    def read_factors(self, names: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
        rows = self._between(self.table("factors"), start, end)
        names = list(names) if names else sorted(r[0] for r in rows.select("factor").distinct().collect())
        return rows.where(F.col("factor").isin(names)).groupBy("date").pivot("factor", names).agg(F.first("value")).orderBy("date")

    def read_rates(self, ids: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
        rows = self._between(self.table("rates"), start, end)
        ids = list(ids) if ids else sorted(r[0] for r in rows.select("series_id").distinct().collect())
        return rows.where(F.col("series_id").isin(ids)).groupBy("date").pivot("series_id", ids).agg(F.first("value")).orderBy("date")

    def assets(self) -> dict[str, dict]:
        return {r["ticker"]: r.asDict() for r in self.table("assets").collect()}

    def calendar_for(self, ticker: str) -> Calendar:
        return Calendar.parse(self.assets().get(ticker, {}).get("calendar"))

    def last_date(self, ticker: str):
        return self.table("prices", [ticker]).agg(F.max("date")).head()[0]

    def available_tickers(self) -> list[str]:
        return sorted(self.parts("prices"))

    # -------------------------------------------------------- SQL

    def sql(self, query: str) -> DataFrame:
        """Spark SQL in which prices(), rates() and factors() are table functions, the last two if there are such tables."""
        for name in ("prices", "rates", "factors"):
            if name == "prices" or self.exists(name):
                table_function(self.spark, name, self.table(name))
        return self.spark.sql(query)
