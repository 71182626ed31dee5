"""Ingestion: sources that fail without stopping the rest, incremental price updates, and retries."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.panel import drop_empty_rows, keep_last, positive
from marlstone.sources.registry import SOURCES, source
from marlstone.sources.store import Store

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class IngestResult:
    name: str
    ok: bool
    rows: int = 0
    first: object = None
    last: object = None
    error: str = ""
    data: DataFrame | None = None


def ingest(name: str, fetch: Callable[[], DataFrame], validate: Callable[[DataFrame], DataFrame] = drop_empty_rows) -> IngestResult:
    """Fetch, validate and sum up; an exception becomes a failed result."""
    try:
        data = validate(fetch())
        first, last, n = data.agg(F.min("date"), F.max("date"), F.count(F.lit(1))).head()
        return IngestResult(name, True, n, first, last, data=data)
    except Exception as e:  # noqa: BLE001  a source's failure is a result
        log.warning("%s failed: %s", name, e)
        return IngestResult(name, False, error=str(e))


def with_retry(get: Callable[[], object], transient: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError), attempts: int = 3, delay: float = 1.5):
    """Call ``get`` until it works, waiting a constant time; after the last transient failure a RuntimeError."""
    for k in range(attempts):
        try:
            return get()
        except transient as e:
            last = e
            if k < attempts - 1:
                time.sleep(delay)
    raise RuntimeError(f"gave up after {attempts} attempts: {last}") from last


class Pipeline:
    """Updates a store from ``fetch_prices(ticker, start)``, ``fetch_rate(id, start)`` and ``fetch_factors(name, start)``."""

    def __init__(self, store: Store, fetch_prices=None, fetch_rate=None, fetch_factors=None):
        self.store, self.fetch_prices, self.fetch_rate, self.fetch_factors = store, fetch_prices, fetch_rate, fetch_factors

    def update_prices(self, tickers: Sequence[str], start: str = "2015-01-01", incremental: bool = True, asset_classes: dict[str, str] | None = None, today: dt.date | None = None) -> list[IngestResult]:
        """From the day after each ticker's last date on; a ticker that is up to date is skipped but keeps its metadata."""
        today, out = today or dt.date.today(), []
        for t in tickers:
            origin = source("prices", t)
            since = start
            if incremental and (last := self.store.last_date(t)) is not None:
                since = (last + dt.timedelta(days=1)).isoformat()
            if since > today.isoformat():
                out.append(IngestResult(t, True))
            else:
                r = ingest(t, lambda t=t, since=since: self.fetch_prices(t, since), positive)
                if r.ok and r.rows:
                    self.store.write_prices(t, r.data)
                out.append(r)
            if out[-1].ok:
                self.store.write_asset(t, origin.calendar.value, (asset_classes or {}).get(t, origin.asset_class), origin.backend)
        return out

    def update_rates(self, ids: Sequence[str], start: str = "1990-01-01") -> list[IngestResult]:
        """All series that work in one upsert, so a failed series never loses what is stored."""
        out, parts = [], []
        for i in ids:
            r = ingest(i, lambda i=i: self.fetch_rate(i, start), lambda df: df.where("value is not null"))
            if r.ok:
                s = SOURCES.get(("rates", i))
                parts.append(r.data.select("date", F.lit(i).alias("series_id"), "value", F.lit(s.currency if s else None).cast("string").alias("currency"), F.lit(s.backend if s else None).cast("string").alias("source")))
            out.append(r)
        if parts:
            self.store.write_series(_union(parts), "rates")
        return out

    def update_factors(self, names: Sequence[str], start: str | None = None) -> list[IngestResult]:
        out, parts = [], []
        for n in names:
            r = ingest(n, lambda n=n: self.fetch_factors(n, start), lambda df: df.where("value is not null"))
            if r.ok:
                parts.append(r.data.withColumn("__k", F.lit(len(parts))))
            out.append(r)
        if parts:
            self.store.write_series(keep_last(_union(parts), ["date", "factor"], ["__k"]).drop("__k"), "factors")
        return out


def ingest_specification(spec, store: Store, connectors) -> list[IngestResult]:
    """Prices, rates and factors that a specification names; what fails is reported and the rest goes on, as the store may
    hold enough from before."""
    p = Pipeline(store, connectors.prices, connectors.rate, connectors.factors)
    out = p.update_prices([x.ticker for x in spec.positions], spec.start or "2015-01-01", asset_classes=spec.asset_classes)
    out += p.update_rates(list(spec.rates), spec.start or "1990-01-01")
    out += p.update_factors(list(spec.factor_datasets), spec.factor_start)
    for r in out:
        if not r.ok:
            log.warning("%s could not be ingested: %s", r.name, r.error)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
