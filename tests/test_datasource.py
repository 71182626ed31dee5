"""The data source over landed files and over a pretended network, its stream, and the table functions."""

import datetime as dt
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.sources import datasource, texts
from marlstone.sources.store import Store

RATES = "observation_date,DGS2\n2024-01-01,4.5\n2024-01-02,.\n2024-01-03,4.25\nno date,1\n2024-01-04,4.0\n"
ECB = 'KEY,TIME_PERIOD,OBS_VALUE,NOTE\nX,2024-01-02,3.9,"a, b"\nX,2024-01-03,,\nX,2024-01-05,3.8,\n'
BLOCK = "Some text\n1,2,3\n\n,Mkt-RF,SMB\n20240102, 1.00, -0.50\n20240103, 0.25, x\n\n Annual\n2024, 9, 9\n20240105, 7, 7\n"


def land(base, kind, name, body, file="part-0"):
    folder = os.path.join(base, kind, f"series={name}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, file), "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())


def zipped(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.csv", text)
    return out.getvalue()


@pytest.fixture
def landed(tmp_path):
    base = str(tmp_path / "landed")
    land(base, "rates", "USD_2Y", RATES)
    land(base, "rates", "EUR_DFR", ECB)
    land(base, "factors", "FF3", zipped(BLOCK))
    return base


def test_rates_are_fetched_in_executors(spark, landed):
    datasource.register(spark)
    rows = datasource.series(spark, "rates", ["USD_2Y", "EUR_DFR", "USD_10Y"], landed=landed)
    assert rows.rdd.getNumPartitions() == 3
    found = sorted((r["series_id"], str(r["date"]), r["value"]) for r in rows.where("error is null").collect())
    assert found == [("EUR_DFR", "2024-01-02", 3.9), ("EUR_DFR", "2024-01-05", 3.8), ("USD_2Y", "2024-01-01", 4.5), ("USD_2Y", "2024-01-03", 4.25), ("USD_2Y", "2024-01-04", 4.0)]
    errors = rows.where("error is not null").collect()
    assert [(r["series_id"], r["date"], r["value"]) for r in errors] == [("USD_10Y", None, None)] and "no landed files" in errors[0]["error"]
    with pytest.raises(Exception, match="unknown rates"):
        datasource.series(spark, "rates", ["X"], landed=landed).collect()


def test_factors_and_filters(spark, landed):
    datasource.register(spark)
    found = sorted(map(tuple, datasource.series(spark, "factors", ["FF3"], landed=landed).drop("error").collect()))
    assert found == [(dt.date(2024, 1, 2), "Mkt-RF", 0.01, "FF3"), (dt.date(2024, 1, 2), "SMB", -0.005, "FF3"), (dt.date(2024, 1, 3), "Mkt-RF", 0.0025, "FF3")]
    rows = datasource.series(spark, "rates", ["USD_2Y", "EUR_DFR"], landed=landed)
    kept = rows.where((F.col("date") > F.lit("2024-01-01").cast("date")) & (F.col("date") <= F.lit("2024-01-03").cast("date")) & (F.col("series_id") == "USD_2Y"))
    assert [(str(r["date"]), r["value"]) for r in kept.collect()] == [("2024-01-03", 4.25)]
    assert kept.rdd.getNumPartitions() == 1  # the other series is not fetched


def test_pushed_bounds_reach_what_is_asked_for():
    day = dt.date(2024, 1, 5)
    reader = datasource.SeriesReader([datasource.Series("rates", n, datasource.FIRST, datasource.LAST) for n in ("USD_2Y", "EUR_DFR")], None, None)
    filters = [datasource.GreaterThan(("date",), day), datasource.LessThan(("date",), dt.date(2024, 2, 1)), datasource.In(("series_id",), ("USD_2Y",)), datasource.EqualTo(("value",), 1.0)]
    assert list(reader.pushFilters(filters)) == filters
    assert reader.partitions() == [datasource.Series("rates", "USD_2Y", dt.date(2024, 1, 6), dt.date(2024, 1, 31))]
    candles = datasource.SeriesReader([datasource.Series("prices", "BTC-USD", dt.date(2020, 1, 1), dt.date(2024, 1, 1))], None, None).partitions()
    assert [p.start for p in candles] == [dt.date(2020, 1, 1), dt.date(2022, 9, 27)] and candles[-1].end == dt.date(2024, 1, 1)


def test_a_network_of_its_own(spark):
    """What fetches travels to the executors; a broken provider costs its own series only."""

    def get(url, params=None, headers=None, timeout=30):
        if "klines" in url:
            day = 86_400_000
            return json.dumps([[t, "1", "2", "0.5", "1.5", "9"] for t in range(params["startTime"], params["startTime"] + 5 * day, day)]).encode()
        if "chart" in url:
            quote = {c: [1.0, None] for c in ("open", "high", "low", "close", "volume")}
            return json.dumps({"chart": {"result": [{"timestamp": [1704205800, 1704292200], "meta": {"gmtoffset": -18000}, "indicators": {"quote": [quote]}}]}}).encode()
        raise ConnectionError("down")

    datasource.register(spark, get)
    try:
        rows = datasource.series(spark, "prices", ["SPY", "BTC-USD"], "2024-01-01", "2024-01-03").where("error is null")
        found = sorted((r["ticker"], str(r["date"]), r["close"]) for r in rows.collect())
        assert found == [("BTC-USD", "2024-01-01", 1.5), ("BTC-USD", "2024-01-02", 1.5), ("BTC-USD", "2024-01-03", 1.5), ("SPY", "2024-01-02", 1.0), ("SPY", "2024-01-03", None)]
        errors = datasource.series(spark, "rates", ["USD_2Y"]).collect()
        assert [(r["series_id"], r["error"]) for r in errors] == [("USD_2Y", "ConnectionError: down")]
    finally:
        datasource.register(spark)


def test_ingest_goes_on_from_the_last_date(spark, landed, tmp_path):
    datasource.register(spark)
    store = Store(spark, str(tmp_path / "store"))
    first = datasource.ingest_series(store, "rates", ["USD_2Y", "USD_10Y"], landed=landed)
    assert [(r.name, r.ok, r.rows) for r in first] == [("USD_2Y", True, 3), ("USD_10Y", False, 0)]
    land(landed, "rates", "USD_2Y", "2024-01-05,3.5\n", "part-1")
    again = datasource.ingest_series(store, "rates", ["USD_2Y", "USD_10Y"], landed=landed)
    assert [(r.ok, r.rows) for r in again] == [(True, 1), (False, 0)]
    found = sorted((str(r["date"]), r["value"], r["currency"], r["source"]) for r in store.table("rates").collect())
    assert [f[:2] for f in found] == [("2024-01-01", 4.5), ("2024-01-03", 4.25), ("2024-01-04", 4.0), ("2024-01-05", 3.5)] and found[0][2:] == ("USD", "fred")
    assert [r.rows for r in datasource.ingest_series(store, "factors", ["FF3"], landed=landed)] == [3]


def test_a_stream_resumes_at_its_marks(spark, tmp_path):
    """Rows that land before, between and after restarts come once each."""
    datasource.register(spark)
    base, out, marks = str(tmp_path / "landed"), str(tmp_path / "out"), str(tmp_path / "marks")
    land(base, "rates", "USD_2Y", "d,v\n2024-01-01,1\n2024-01-02,2\n")

    def run():
        rows = spark.readStream.format("series").option("kind", "rates").option("names", "USD_2Y,USD_10Y").option("landed", base).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["series_id"], str(r["date"]), r["value"]) for r in spark.read.parquet(out).collect())

    assert run() == [("USD_2Y", "2024-01-01", 1.0), ("USD_2Y", "2024-01-02", 2.0)]
    land(base, "rates", "USD_2Y", "2024-01-03,3\n", "part-1")
    land(base, "rates", "USD_10Y", "d,v\n2024-01-02,7\n")
    assert run() == [("USD_10Y", "2024-01-02", 7.0), ("USD_2Y", "2024-01-01", 1.0), ("USD_2Y", "2024-01-02", 2.0), ("USD_2Y", "2024-01-03", 3.0)]
    assert len(run()) == 4


def test_table_functions_stream_files_through(spark, tmp_path):
    datasource.register_table_functions(spark)
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(BLOCK.replace("SMB", f"SMB{k}"))
    (tmp_path / "none.csv").write_text("nothing\n")
    datasource.lines_of(spark, str(tmp_path)).createOrReplaceTempView("factor_lines")
    found = spark.sql("SELECT * FROM factor_blocks(TABLE(factor_lines)) WHERE factor LIKE 'SMB%'").collect()
    assert sorted((r["factor"], str(r["date"]), r["value"]) for r in found) == [(f"SMB{k}", "2024-01-02", -0.005) for k in range(3)]
    spark.createDataFrame([("a", k, s) for k, s in enumerate(RATES.splitlines())] + [("b", 0, "x,y"), ("b", 1, None)], "file string, n int, line string").createOrReplaceTempView("rate_text")
    found = spark.sql("SELECT file, date, value FROM rate_lines(TABLE(rate_text))").collect()
    assert sorted((r["file"], str(r["date"]), r["value"]) for r in found) == [("a", "2024-01-01", 4.5), ("a", "2024-01-03", 4.25), ("a", "2024-01-04", 4.0)]
    with pytest.raises(Exception, match="file, n and line"):
        spark.sql("SELECT * FROM rate_lines(TABLE(SELECT 1 AS x))").collect()


def test_texts_of_any_shape():
    assert list(texts.rate_rows([])) == [] and list(texts.observation_rows([])) == []
    assert texts.number("nan") is None and texts.number("-inf") == float("-inf") and texts.number(None) is None
    with pytest.raises(ValueError):
        list(texts.factor_rows(["a", "b"]))
    assert list(texts.candle_rows([])) == []
