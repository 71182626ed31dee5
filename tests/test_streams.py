"""Streams whose rows come shuffled, against the batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marlstone.streaming import twins

SCHEMA = "run_id string, at timestamp, ticker string, ret double"
TARGETS = {"a": {"X": 0.6, "Y": 0.4}, "b": {"X": 1.0}}
END = dt.datetime(2200, 1, 1)


def returns(seed=1, days=90):
    r = random.Random(seed)
    return [(run, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), t, round(r.gauss(0, 0.02), 6)) for run in ("a", "b", "c") for k in range(days) for t in ("X", "Y")]


def land(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def shuffled_within(rows, days, parts, seed=2):
    """Batches of rows, each row moved by up to ``days`` from its place in time."""
    r = random.Random(seed)
    moved = sorted(rows, key=lambda x: x[1] + dt.timedelta(days=r.uniform(0, days)))
    size = -(-len(moved) // parts)
    return [moved[k : k + size] for k in range(0, len(moved), size)]


def read(spark, folder, schema, column, late="10 days"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark(column, late)


def test_books_by_run_when_bars_come_shuffled(spark, tmp_path):
    rows, folder = returns(), str(tmp_path / "in")
    land(spark, folder, [*shuffled_within(rows, 8, 6), [(run, END, "X", 0.0) for run in "abc"]], SCHEMA)
    found = twins.finished(twins.book_stream(read(spark, folder, SCHEMA, "at"), TARGETS), "books").where("date < '2200-01-01'")
    whole = twins.books_of_batch(spark.createDataFrame(rows, SCHEMA), TARGETS)
    key = lambda r: (r["run_id"], r["date"])
    a, b = sorted(found.collect(), key=key), sorted(whole.collect(), key=key)
    assert len(a) == len(b) == 270
    for x, y in zip(a, b):
        assert key(x) == key(y) and abs(x["equity"] - y["equity"]) < 1e-12 and abs(x["drawdown"] - y["drawdown"]) < 1e-12
        assert x["weights"].keys() == y["weights"].keys() and all(abs(x["weights"][t] - w) < 1e-12 for t, w in y["weights"].items())
    first = [r for r in b if r["run_id"] == "a"][0]
    moved = {t: v for run, at, t, v in rows if run == "a" and at == dt.datetime(2024, 1, 1)}
    assert abs(first["equity"] - (1 + 0.6 * moved["X"] + 0.4 * moved["Y"])) < 1e-12


def test_drawdowns_when_bars_come_shuffled_and_late(spark, tmp_path):
    schema = "ticker string, at timestamp, price double"
    r = random.Random(5)
    rows = [(t, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), round(r.uniform(50, 150), 2)) for t in ("A", "B") for k in range(60)]
    folder = str(tmp_path / "in")
    late = [("A", dt.datetime(2024, 1, 2, 12), 9999.0)]
    land(spark, folder, [*shuffled_within(rows, 8, 5), late, [(t, END, 1.0) for t in "AB"]], schema)
    found = twins.finished(twins.ordered_drawdown_stream(read(spark, folder, schema, "at")), "drawdowns").where("date < '2200-01-01'").collect()
    truth, peak = {}, {}
    for t, at, price in sorted(rows):
        peak[t] = max(peak.get(t, 0.0), price)
        truth[t, at.date()] = (peak[t], price / peak[t] - 1)
    assert {(x["ticker"], x["date"]): (x["peak"], x["drawdown"]) for x in found} == truth


def test_lag_join_when_both_sides_come_shuffled(spark, tmp_path):
    r = random.Random(7)
    days = sorted(r.sample(range(300), 200))
    known = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(k)) for k in days]
    asked = [(t, at) for t, at, _ in known]
    a, b = str(tmp_path / "asked"), str(tmp_path / "known")
    land(spark, a, [*shuffled_within(asked, 8, 4), [("A", END)]], "ticker string, as_of timestamp")
    land(spark, b, [*shuffled_within(known, 8, 4, 3), [("A", END, 0.0)]], "ticker string, at timestamp, ret double")
    joined = twins.lagged_join_stream(read(spark, a, "ticker string, as_of timestamp", "as_of"), read(spark, b, "ticker string, at timestamp, ret double", "at"))
    found = {x["as_of"]: (x["known"], x["ret"]) for x in twins.finished(joined, "lagged").collect() if x["as_of"] < END}
    truth = {}
    for _, as_of in asked:
        seen = [(at, v) for _, at, v in known if at <= as_of - dt.timedelta(days=45)]
        if seen:
            truth[as_of] = max(seen)
    assert found == truth and len(truth) > 100
