"""Series of registered providers as a Spark data source, batch and stream, and their texts as table functions.

``spark.read.format("series").option("kind", "rates").option("names", "USD_2Y,USD_10Y").load()`` fetches in executors: each
series is a partition, an exchange's candles one for each span of pages. Bounds of ``date`` and the choice of series are
pushed down, so nothing is fetched that a filter leaves out. A series that fails is a row with its ``error``, so the others
come through. With ``landed`` the texts are read from files that another process has put there,
``{landed}/{kind}/series={name}/…``, in any file system that pyarrow knows; without, from the providers.

As a stream the offset is each series' high-water mark, the last date that has been read: a restart goes on from the marks in
the checkpoint.
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql import types as T

from marlstone.sources import parsers, texts
from marlstone.sources.connectors import ECB, EXCHANGES, FRED, FRENCH, PAGE, YAHOO, http_get, millis
from marlstone.sources.ingest import IngestResult
from marlstone.sources.registry import source

SCHEMAS = {
    "prices": "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double, error string",
    "rates": "date date, series_id string, value double, error string",
    "factors": "date date, factor string, value double, source string, error string",
}
#: The column that names the series a row was fetched for.
NAMED = {"prices": "ticker", "rates": "series_id", "factors": "source"}
FIRST, LAST = dt.date(1900, 1, 1), dt.date(9999, 12, 31)
DAY = dt.timedelta(days=1)


@dataclass
class Series(InputPartition):
    """What one task fetches: a series between two dates, both included."""

    kind: str
    name: str
    start: dt.date
    end: dt.date


def landed_body(base: str, kind: str, name: str, tail: int | None = None) -> bytes:
    """The files of a landed series behind one another, in the order in which they were written, or their last bytes."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base)
    folder = f"{path}/{kind}/series={urllib.parse.quote(name, safe='')}"
    found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    files = [f.path for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.size]
    if not files:
        raise FileNotFoundError(f"no landed files of {name}")
    parts = []
    for file in files[-1:] if tail else files:
        with system.open_input_file(file) as f:
            if tail and f.size() > tail:
                f.seek(f.size() - tail)
            parts.append(f.read())
    return b"".join(parts)


def fetched(p: Series, landed: str | None, get: Callable[..., bytes]) -> Iterator[tuple]:
    """Rows of the kind's schema, without the error, of one partition."""
    s = source(p.kind, p.name)
    if landed:
        body = landed_body(landed, p.kind, p.name)
    elif s.backend == "fred":
        body = get(FRED, params={"id": s.code, "cosd": p.start.isoformat()} | ({"coed": p.end.isoformat()} if p.end < LAST else {}), timeout=60)
    elif s.backend == "ecb":
        flow, key = parsers.ecb_key(s.code)
        body = get(f"{ECB}/{flow}/{key}", params={"format": "csvdata", "startPeriod": p.start.isoformat()} | ({"endPeriod": p.end.isoformat()} if p.end < LAST else {}), headers={"Accept": "text/csv"}, timeout=60)
    elif s.backend == "french":
        body = get(FRENCH + s.code, timeout=60)
    elif s.backend == "yahoo":
        until = min(p.end + DAY, dt.date.today() + DAY) if p.end < LAST else dt.date.today() + DAY
        body = get(YAHOO + urllib.parse.quote(s.code), params={"period1": millis(p.start.isoformat()) // 1000, "period2": millis(until.isoformat()) // 1000, "interval": "1d"})
    else:
        until = millis((min(p.end, LAST - DAY) + DAY).isoformat()) - 1
        page = lambda since, limit: json.loads(get(EXCHANGES[s.venue], params={"symbol": s.code.replace("/", ""), "interval": "1d", "startTime": since, "limit": limit}))
        body = json.dumps([parsers.paginate(page, millis(p.start.isoformat()), PAGE, until)]).encode()
    if s.backend == "french":
        rows = ((d, f, v, p.name) for d, f, v in texts.factor_rows(texts.unpacked(body).splitlines()))
    elif s.backend == "yahoo":
        rows = ((d, p.name, *v) for d, *v in texts.price_rows(body))
    elif s.backend == "exchange":
        rows = ((d, p.name, *v) for d, *v in texts.candle_rows(json.loads(body)))
    else:
        read = texts.rate_rows if s.backend == "fred" else texts.observation_rows
        rows = ((d, p.name, v) for d, v in read(texts.unpacked(body).splitlines()))
    return (r for r in rows if p.start <= r[0] <= p.end)


def safely(p: Series, landed: str | None, get: Callable[..., bytes]) -> Iterator[tuple]:
    """The rows; a failure is one row with its error after what came before it."""
    try:
        for row in fetched(p, landed, get):
            yield (*row, None)
    except Exception as e:  # noqa: BLE001  a series' failure is a row
        columns = [c.split()[0] for c in SCHEMAS[p.kind].split(", ")]
        yield tuple(p.name if c == NAMED[p.kind] else f"{type(e).__name__}: {e}" if c == "error" else None for c in columns)


class SeriesSource(DataSource):
    """Options: ``kind``, ``names`` (comma-separated), ``start``, ``end`` and ``landed``; see the module."""

    get = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "series"

    def _wanted(self) -> list[Series]:
        kind = self.options.get("kind", "rates")
        names = [n for n in self.options.get("names", "").split(",") if n]
        for n in names:
            source(kind, n)  # an unknown one is an error at once
        start, end = (dt.date.fromisoformat(self.options[c]) if c in self.options else d for c, d in (("start", FIRST), ("end", LAST)))
        return [Series(kind, n, start, end) for n in names]

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "rates")]

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(self._wanted(), self.options.get("landed"), self.get)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SeriesStream(self._wanted(), self.options.get("landed"), self.get)


class SeriesReader(DataSourceReader):
    def __init__(self, wanted: list[Series], landed: str | None, get: Callable[..., bytes]):
        self.wanted, self.landed, self.get = wanted, landed, get

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the date and the names of series; a row with an error has no date, and none is wanted by a bound."""
        for f in filters:
            column, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
            named = self.wanted and column == (NAMED[self.wanted[0].kind],)
            if column == ("date",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo) and isinstance(value, dt.date):
                low = value + DAY if isinstance(f, GreaterThan) else value if isinstance(f, GreaterThanOrEqual | EqualTo) else FIRST
                high = value - DAY if isinstance(f, LessThan) else value if isinstance(f, LessThanOrEqual | EqualTo) else LAST
                self.wanted = [replace(s, start=max(s.start, low), end=min(s.end, high)) for s in self.wanted]
            elif named and isinstance(f, EqualTo | In):
                self.wanted = [s for s in self.wanted if s.name in ((value,) if isinstance(f, EqualTo) else value)]
            yield f  # Spark filters again: error rows must go

    def partitions(self) -> list[InputPartition]:
        out = []
        for s in self.wanted:
            if s.start > s.end:
                continue
            if not self.landed and source(s.kind, s.name).backend == "exchange":  # a page is a task's work
                end, at = min(s.end, dt.date.today()), max(s.start, dt.date(2010, 1, 1))
                while at <= end:
                    out.append(replace(s, start=at, end=min(end, at + (PAGE - 1) * DAY)))
                    at += PAGE * DAY
            else:
                out.append(s)
        return out or [Series("", "", LAST, FIRST)]

    def read(self, partition: Series) -> Iterator[tuple]:
        return safely(partition, self.landed, self.get) if partition.name else iter(())


class SeriesStream(DataSourceStreamReader):
    """Offsets are JSON objects: series to the last date read, empty before the first."""

    def __init__(self, wanted: list[Series], landed: str | None, get: Callable[..., bytes]):
        self.wanted, self.landed, self.get = wanted, landed, get

    def initialOffset(self) -> dict:
        return {s.name: (s.start - DAY).isoformat() if s.start > FIRST else "" for s in self.wanted}

    def _high_water(self, s: Series) -> str:
        """The last date there is: of a landed series from the end of its last file."""
        if not self.landed:
            return min(s.end, dt.date.today()).isoformat()
        try:
            backend = source(s.kind, s.name).backend
            if backend in ("fred", "ecb"):
                found = [d for line in landed_body(self.landed, s.kind, s.name, 4096).decode("utf-8", "replace").splitlines() for cell in line.split(",") if (d := texts.day(cell)) is not None]
            else:
                found = [r[0] for r in fetched(s, self.landed, self.get)]
            return min(max(found), s.end).isoformat()
        except (OSError, ValueError):
            return ""

    def latestOffset(self) -> dict:
        return {s.name: self._high_water(s) for s in self.wanted}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for s in self.wanted:
            after, upto = start.get(s.name, ""), end.get(s.name, "")
            if upto and upto > after:
                out.append(replace(s, start=dt.date.fromisoformat(after) + DAY if after else s.start, end=dt.date.fromisoformat(upto)))
        return out or [Series("", "", LAST, FIRST)]

    def read(self, partition: Series) -> Iterator[tuple]:
        return safely(partition, self.landed, self.get) if partition.name else iter(())

    def commit(self, end: dict) -> None:
        """Nothing is held for what has been read."""


def register(spark: SparkSession, get: Callable[..., bytes] | None = None) -> None:
    """Make the format ``series`` known, fetching with ``get``, which travels to executors, and let filters be pushed to it."""
    bound = SeriesSource if get is None else type("SeriesSource", (SeriesSource,), {"get": staticmethod(get)})
    spark.dataSource.register(bound)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def series(spark: SparkSession, kind: str, names, start: str | None = None, end: str | None = None, landed: str | None = None) -> DataFrame:
    """The rows of some series, fetched in executors when they are read; ``error`` says why a series has none."""
    reader = spark.read.format("series").option("kind", kind).option("names", ",".join(names))
    for key, value in (("start", start), ("end", end), ("landed", landed)):
        reader = reader.option(key, value) if value is not None else reader
    return reader.load()


def ingest_series(store, kind: str, names, start: str | None = None, end: str | None = None, landed: str | None = None) -> list[IngestResult]:
    """Fetch some series in one job, from the day after each one's last stored date on where that is known, and put them into
    the store; a series that fails is a failed result and leaves what is stored as it is."""
    from marlstone.staging import staged

    spark, column = store.spark, NAMED[kind]
    table = store.table(kind)
    last = {r["name"]: r["last"] for r in table.groupBy(F.col(column).alias("name")).agg(F.max("date").alias("last")).collect()}  # one row for each series
    rows = series(spark, kind, names, start, end, landed)
    marks = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(last.get(n)).cast("date"))]) if names else None
    new = staged(rows.where(F.col("error").isNotNull() | marks[F.col(column)].isNull() | (F.col("date") > marks[F.col(column)])), "fetched")
    told = {r["name"]: r for r in new.groupBy(F.col(column).alias("name")).agg(F.count("date").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.max("error").alias("error")).collect()}
    failed = [n for n in names if n in told and told[n]["error"]]
    kept = new.where(F.col("error").isNull() & ~F.col(column).isin(failed)).drop("error") if failed else new.where("error is null").drop("error")
    if kind == "prices":
        for n in names:
            if n in told and n not in failed:
                store.write_prices(n, kept.where(F.col("ticker") == n))
    elif not kept.isEmpty():
        if kind == "rates":
            sources = {n: source(kind, n) for n in names}
            at = lambda f: F.create_map(*[x for n in names for x in (F.lit(n), F.lit(f(sources[n])))])[F.col("series_id")]
            kept = kept.withColumns({"currency": at(lambda s: s.currency), "source": at(lambda s: s.backend)})
        store.write_series(kept, kind)
    return [IngestResult(n, n not in failed, told[n]["rows"] if n in told else 0, told[n]["first"] if n in told else None, told[n]["last"] if n in told else None, (told[n]["error"] or "") if n in told else "") for n in names]


# ---------------------------------------------------------------- table functions


def _by_file(argument: AnalyzeArgument, columns: list) -> AnalyzeResult:
    if not argument.isTable or {"file", "n", "line"} - {f.name for f in argument.dataType.fields}:
        raise ValueError("a table with the columns file, n and line is wanted")
    schema = T.StructType([T.StructField("file", argument.dataType["file"].dataType), *[T.StructField(*c) for c in columns]])
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn("file")], orderBy=[OrderingColumn("n")])


class FactorBlocks:
    """factor_blocks(TABLE(lines)): (file, date, factor, value) of the first daily block of each file's lines (file, n, line).

    A file's lines come to one task in their order and stream through; only the header is kept."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        return _by_file(lines, [("date", T.DateType()), ("factor", T.StringType()), ("value", T.DoubleType())])

    def __init__(self):
        self.block = texts.FactorBlock()

    def eval(self, lines):
        for found in self.block.push(lines["line"] or ""):
            yield (lines["file"], *found)


class RateLines:
    """rate_lines(TABLE(lines)): (file, date, value) of each file's lines under its first one."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        return _by_file(lines, [("date", T.DateType()), ("value", T.DoubleType())])

    def __init__(self):
        self.header = True

    def eval(self, lines):
        if not self.header:
            for found in texts.rate_rows(["", lines["line"] or ""]):
                yield (lines["file"], *found)
        self.header = False


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("factor_blocks", udtf(FactorBlocks))
    spark.udtf.register("rate_lines", udtf(RateLines))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files that Spark can read; ``n`` counts within a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return files
