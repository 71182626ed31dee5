"""Structured Streaming twins of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marlstone.sources.store import Store


def event_stream(spark: SparkSession, folder: str, schema, time_column: str = "ts", lateness: str = "1 day", pattern: str = "*.parquet") -> DataFrame:
    """A file stream with a watermark; times without a zone are read in the session's."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, lateness)


def daily_bars(events: DataFrame, key: str = "event_type", value: str = "value", time_column: str = "ts") -> DataFrame:
    """Tumbling one-day windows: (date, ticker, price, n)."""
    bars = events.groupBy(F.window(time_column, "1 day"), F.col(key).alias("ticker")).agg(F.avg(value).alias("price"), F.count(F.lit(1)).alias("n"))
    return bars.select(F.to_date("window.start").alias("date"), "ticker", "price", "n")


def rolling_mean(events: DataFrame, width: str = "7 days", slide: str = "1 day", key: str = "event_type", value: str = "value", time_column: str = "ts") -> DataFrame:
    bars = events.groupBy(F.window(time_column, width, slide), F.col(key).alias("ticker")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return bars.select(F.col("window.end").alias("end"), "ticker", "mean", "sd")


def gap_sessions(events: DataFrame, gap: str = "4 hours", key: str = "user_id", time_column: str = "ts") -> DataFrame:
    """Sessions that end with a gap: (key, start, end, n)."""
    sessions = events.groupBy(F.session_window(time_column, gap), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


DRAWDOWNS = "date date, ticker string, price double, peak double, drawdown double"


def _after_bars(pdf, peak: float):
    """Rows of DRAWDOWNS for a ticker's bars in the order of their dates, from the peak so far; and the new peak."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("date")
    peaks = np.maximum.accumulate(np.append(peak, pdf["price"].to_numpy(dtype=float)))[1:]
    out = pd.DataFrame({"date": pdf["date"], "ticker": pdf["ticker"], "price": pdf["price"], "peak": peaks, "drawdown": pdf["price"] / peaks - 1})
    return out, float(peaks[-1]) if len(peaks) else peak


def drawdowns_of_batch(pdf):
    return _after_bars(pdf, float("-inf"))[0]


def drawdown_stream(bars: DataFrame) -> DataFrame:
    """Per-bar state: the peak of each ticker is kept between micro-batches, and each bar (date, ticker, price) that comes is
    returned with the peak up to it and its drawdown. A ticker's bars must come in the order of their dates from batch to
    batch; within one they may be in any."""

    def step(key, frames, state):
        import pandas as pd

        peak = state.get[0] if state.exists else float("-inf")
        out, peak = _after_bars(pd.concat(list(frames)), peak)
        state.update((peak,))
        yield out

    return bars.groupBy("ticker").applyInPandasWithState(step, DRAWDOWNS, "peak double", "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: DataFrame, key: str, at: str, step, output: str, state: str) -> DataFrame:
    """Per-key state over rows that may come in any order within the watermark of the event time ``at``.

    Rows wait in list state until the watermark has passed them; an event-time timer then hands them on in the order of their
    times. ``step(key, rows, state or None)`` returns (rows of ``output``, the new state, a tuple of ``state``). A row that comes
    after the watermark has passed its time is late and left out, as by windows. What waits is bounded by the watermark's delay.
    """
    from pyspark.sql.streaming import StatefulProcessor

    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [f for f in rows.schema.fields if f.name != key]
    names = [f.name for f in columns]
    waiting = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)

    class InOrder(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.pending = handle.getListState("pending", waiting)
            self.state = handle.getValueState("state", state)

        def _await(self, times) -> None:
            self.handle.registerTimer(min(int(t.timestamp() * 1000) for t in times))

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
            for pdf in rows:
                new = pdf.loc[pdf[at] > passed, names] if timerValues.getCurrentWatermarkInMs() > 0 else pdf[names]
                if len(new):
                    self.pending.appendList([tuple(r) for r in new.astype(object).itertuples(index=False)])
                    self._await(pd.to_datetime(new[at]))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            held = pd.DataFrame([tuple(r) for r in self.pending.get()], columns=names)
            if not len(held):
                return
            due = pd.to_datetime(held[at]) <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
            if due.any():
                out, now = step(key[0], held[due].sort_values(names), self.state.get() if self.state.exists() else None)
                self.state.update(tuple(now))
                yield out
            rest = held[~due]
            self.pending.clear()
            if len(rest):
                self.pending.put([tuple(r) for r in rest.astype(object).itertuples(index=False)])
                self._await(pd.to_datetime(rest[at]))

        def close(self):
            pass

    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=InOrder(), outputStructType=output, outputMode="Append", timeMode="EventTime")


def ordered_drawdown_stream(bars: DataFrame) -> DataFrame:
    """``drawdown_stream`` for bars (at, ticker, price) that come in any order within the watermark of ``at``."""

    def step(key, pdf, state):
        out, peak = _after_bars(pdf.assign(ticker=key, date=pdf["at"].dt.date)[["date", "ticker", "price"]], state[0] if state else float("-inf"))
        return out, (peak,)

    return in_order(bars.select("ticker", "at", "price"), "ticker", "at", step, DRAWDOWNS, "peak double")


BOOKS = "run_id string, date date, equity double, peak double, drawdown double, weights map<string, double>"


def _after_returns(key, pdf, state, targets: dict[str, float]):
    """Rows of BOOKS for a run's returns (at, ticker, ret) of whole dates in order, from its state; and the new state.

    A run begins each month with its target weights and drifts until the next one."""
    import pandas as pd

    month, equity, peak, names, held = state if state else (-1, 1.0, 0.0, sorted(targets), [])
    weights, out = dict(zip(names, held)), []
    for at, day in pdf.groupby("at", sort=True):
        if (now := at.year * 12 + at.month) != month:
            month, weights = now, dict(targets)
        moved = dict(zip(day["ticker"], day["ret"]))
        gain = sum(w * moved.get(t, 0.0) for t, w in weights.items())
        weights = {t: w * (1 + moved.get(t, 0.0)) / (1 + gain) for t, w in weights.items()}
        equity *= 1 + gain
        peak = max(peak, equity)
        out.append((key, at.date(), equity, peak, equity / peak - 1, dict(weights)))
    return pd.DataFrame(out, columns=["run_id", "date", "equity", "peak", "drawdown", "weights"]), (month, equity, peak, sorted(weights), [weights[t] for t in sorted(weights)])


def book_stream(returns: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """Weights, equity and drawdown of several books as a stream of (run_id, at, ticker, ret), which may come in any order within
    the watermark of ``at``. A date is counted once, when the watermark passes it; runs without targets hold nothing."""
    return in_order(returns.select("run_id", "at", "ticker", "ret"), "run_id", "at", lambda key, pdf, state: _after_returns(key, pdf, state, targets.get(key, {})), BOOKS, "month int, equity double, peak double, names array<string>, weights array<double>")


def books_of_batch(returns: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """The same rows from a whole table."""
    return returns.select("run_id", "at", "ticker", "ret").groupBy("run_id").applyInPandas(lambda key, pdf: _after_returns(key[0], pdf, None, targets.get(key[0], {}))[0], BOOKS)


def lagged_join_stream(asked: DataFrame, known: DataFrame, lag: str = "45 days", most: str = "40 days") -> DataFrame:
    """(ticker, as_of, known, ret): for each asked (ticker, as_of) the last known (ticker, at, ret) whose time and ``lag`` are
    over, of those that came out at most ``most`` before.

    A stream-stream join over an interval of time: both sides carry a watermark, so what waits on either side is bounded by the
    interval and the delays. The last one is the maximum by ``as_of``, given when the watermark has passed it."""
    left, right = asked.select("ticker", "as_of"), known.select(F.col("ticker").alias("__ticker"), F.col("at").alias("known"), "ret")
    due = F.expr(f"as_of >= known + INTERVAL {lag} AND as_of <= known + INTERVAL {lag} + INTERVAL {most}")
    met = left.join(right, (F.col("ticker") == F.col("__ticker")) & due)
    last = met.groupBy("ticker", "as_of").agg(F.max(F.struct("known", "ret")).alias("x"))
    return last.select("ticker", "as_of", "x.known", "x.ret")


def finished(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that is there, and read the table that it wrote."""
    from marlstone.staging import scratch_dir

    base = f"{scratch_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/marks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def upsert_stream(rows: DataFrame, store: Store, name: str, checkpoint: str):
    """Write a stream of series rows into the store; late and corrected rows replace earlier ones by key."""
    return rows.writeStream.foreachBatch(lambda batch, _: store.write_series(batch, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
