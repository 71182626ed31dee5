"""Connectors: fetch a series where the registry says it is and parse it into the store's columns.

What is fetched is one series' small text or pages of candles; it becomes a DataFrame at once. ``get`` can be replaced, by a
test's or by one that reads files which another process has landed.
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources import parsers
from marlstone.sources.ingest import with_retry
from marlstone.sources.registry import source

# The providers' public addresses, and headers that they expect.
FRED = "https://fred.stlouisfed.org/graph/fredgraph.csv"
ECB = "https://data-api.ecb.europa.eu/service/data"
FRENCH = "https://mba.tuck.dartmouth.edu/pages/faculty/ken.french/ftp/"
YAHOO = "https://query1.finance.yahoo.com/v8/finance/chart/"
EXCHANGES = {"binance": "https://api.binance.com/api/v3/klines"}
HEADERS = {"User-Agent": "Mozilla/5.0 (X11; Linux x86_64)", "Accept": "*/*"}
PAGE = 1000


class ServerError(ConnectionError):
    """An answer with an error status."""


def http_get(url: str, params: Mapping | None = None, headers: Mapping | None = None, timeout: float = 30, attempts: int = 3, delay: float = 1.5, opener: Callable = urllib.request.urlopen) -> bytes:
    """The body of an answer. Timeouts, broken connections and error statuses are tried again after a constant time; after the
    last attempt they are a RuntimeError. ``headers`` go over the usual ones."""
    full = url + ("?" + urllib.parse.urlencode(params) if params else "")
    request = urllib.request.Request(full, headers={**HEADERS, **(headers or {})})

    def once() -> bytes:
        try:
            with opener(request, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            raise ServerError(f"{url} answered {e.code}") from e
        except urllib.error.URLError as e:
            raise ConnectionError(f"{url}: {e.reason}") from e

    return with_retry(once, attempts=attempts, delay=delay)


def millis(date: str) -> int:
    return int(dt.datetime.fromisoformat(date).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


class Connectors:
    """Fetch functions for an ingestion pipeline: ``prices(ticker, start)``, ``rate(id, start)``, ``factors(name, start)``."""

    def __init__(self, spark: SparkSession, get: Callable[..., bytes] = http_get, end: str | None = None):
        self.spark, self.get, self.end = spark, get, end
        self.backends = {"yahoo": self._yahoo, "exchange": self._exchange, "fred": self._fred, "ecb": self._ecb, "french": self._french}

    def _fetch(self, kind: str, name: str, start: str | None) -> DataFrame:
        s = source(kind, name)
        return self.backends[s.backend](s, start)

    def prices(self, ticker: str, start: str) -> DataFrame:
        return self._fetch("prices", ticker, start).withColumn("ticker", F.lit(ticker))

    def rate(self, name: str, start: str) -> DataFrame:
        return self._fetch("rates", name, start)

    def factors(self, name: str, start: str | None = None) -> DataFrame:
        return self._fetch("factors", name, start)

    def _yahoo(self, s, start) -> DataFrame:
        until = millis(self.end) if self.end else int(dt.datetime.now(dt.timezone.utc).timestamp() * 1000)
        body = json.loads(self.get(YAHOO + urllib.parse.quote(s.code), params={"period1": millis(start) // 1000, "period2": until // 1000, "interval": "1d"}))
        found = (body["chart"]["result"] or [{}])[0]
        if not found.get("timestamp"):
            raise ValueError(f"no prices of {s.name}")
        offset, quote = found["meta"].get("gmtoffset", 0), found["indicators"]["quote"][0]
        columns = [quote[c] for c in ("open", "high", "low", "close")] + [(found["indicators"].get("adjclose") or [{"adjclose": quote["close"]}])[0]["adjclose"], quote["volume"]]
        days = [(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t + offset)).date() for t in found["timestamp"]]
        rows = [(d, *[None if v is None else float(v) for v in values]) for d, *values in zip(days, *columns)]
        return parsers.ohlcv(self.spark.createDataFrame(rows, "date date, open double, high double, low double, close double, adj_close double, volume double"), s.name)

    def _exchange(self, s, start) -> DataFrame:
        def page(since: int, limit: int) -> list[list]:
            body = json.loads(self.get(EXCHANGES[s.venue], params={"symbol": s.code.replace("/", ""), "interval": "1d", "startTime": since, "limit": limit}))
            return [[int(c[0]), *[float(v) for v in c[1:6]]] for c in body]

        rows = parsers.paginate(page, millis(start), PAGE, millis(self.end) if self.end else None)
        if not rows:
            raise ValueError(f"no candles of {s.name}")
        return parsers.exchange_candles(self.spark.createDataFrame([tuple(r) for r in rows], "ts long, open double, high double, low double, close double, volume double"), s.name, self.end)

    def _fred(self, s, start) -> DataFrame:
        params = {"id": s.code, "cosd": start} | ({"coed": self.end} if self.end else {})
        return parsers.fred_csv(self.spark, text=self.get(FRED, params=params, timeout=60).decode())

    def _ecb(self, s, start) -> DataFrame:
        flow, key = parsers.ecb_key(s.code)
        params = {"format": "csvdata", "startPeriod": start} | ({"endPeriod": self.end} if self.end else {})
        return parsers.ecb_csv(self.spark, text=self.get(f"{ECB}/{flow}/{key}", params=params, headers={"Accept": "text/csv"}, timeout=60).decode())

    def _french(self, s, start) -> DataFrame:
        rows = parsers.french_archive(self.spark, self.get(FRENCH + s.code, timeout=60), s.name)
        for bound, keep in ((start, F.col("date") >= F.lit(start).cast("date")), (self.end, F.col("date") <= F.lit(self.end).cast("date"))):
            rows = rows.where(keep) if bound else rows
        return rows
