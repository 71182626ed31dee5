"""Regimes: switching models, volatility states, and statistics by state."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import numeric, switching
from marlstone.operators.covariance import pairs
from marlstone.operators.performance import frame
from marlstone.staging import staged


def labels(n: int) -> list[str]:
    """Names of states by ascending volatility."""
    return {1: ["normal"], 2: ["calm", "stress"], 3: ["calm", "normal", "stress"]}.get(n, [f"state {i}" for i in range(n)])


STATE_SCHEMA = "date date, smoothed array<double>, filtered array<double>, state int, filtered_state int, loglik double, means array<double>, sds array<double>, transition array<double>, durations array<double>"


def fit_regimes(returns: DataFrame, by: Sequence[str] = (), states: int = 2, restarts: int = 5, seed: int = 42) -> DataFrame:
    """(by…, date, smoothed, filtered, state, filtered_state, loglik, means, sds, transition, durations) of each track.

    Every restart of every track is a group of its own, so restarts run beside each other; the best likelihood wins, the
    first of equals. States are ordered by volatility. Smoothed probabilities use the whole track, filtered ones its past.
    """
    by = list(by)
    keys = [f"{c} {returns.schema[c].dataType.simpleString()}" for c in by]
    starts = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))
    fan = returns.select(*by, "date", "ret", starts.alias("start"))

    def fit(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("date")
        start = int(key[-1])
        m = numeric.fit_switching(pdf["ret"].to_numpy(), states, restarts, seed, only=start)
        out = pd.DataFrame({"date": pdf["date"].to_numpy()})
        for c, v in zip(by, key):
            out.insert(0, c, v)
        out["start"] = start
        out["smoothed"], out["filtered"] = list(m["smoothed"]), list(m["filtered"])
        out["state"], out["filtered_state"] = m["smoothed"].argmax(axis=1), m["filtered"].argmax(axis=1)
        out["loglik"] = m["loglik"]
        for name, v in (("means", m["means"]), ("sds", m["sds"]), ("transition", m["transition"].ravel()), ("durations", m["durations"])):
            out[name] = [v] * len(out)
        return out[[*by, "start", *[c.split()[0] for c in STATE_SCHEMA.split(", ")]]]

    every = fan.groupBy(*by, "start").applyInPandas(fit, ", ".join([*keys, "start int", STATE_SCHEMA]))
    best = F.max(F.struct("loglik", (-F.col("start")).alias("s"))).over(W.partitionBy(*(by or [F.lit(1)])))
    return every.withColumn("__best", best).where(F.col("start") == -F.col("__best.s")).drop("__best", "start")


#: Rows of a span of one long series; a series of one span is fitted by one task for each start.
SPAN_ROWS = 65_536


def series_spans(returns: DataFrame, span_rows: int = SPAN_ROWS) -> tuple[DataFrame, list[int]]:
    """(span, n, dates, values) of one series cut by date, a row for each span, as a staged table; and the spans' sizes."""
    import pyarrow as pa

    rows = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret")).select(F.col("date").cast("date").alias("date"), F.col("ret").cast("double").alias("ret"))
    rows = staged(rows, "series")
    parts = max(1, -(-rows.count() // span_rows))

    def pack(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            dates = table.column(0).combine_chunks().cast(pa.int32()).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([len(table)]), pa.array([dates.tobytes()], pa.binary()), pa.array([table.column(1).to_numpy().tobytes()], pa.binary())], names=["span", "n", "dates", "values"])

    spans = rows.repartitionByRange(parts, "date").sortWithinPartitions("date").mapInArrow(pack, "span long, n long, dates binary, values binary")
    spans = staged(spans, "spans")
    sizes = {r["span"]: r["n"] for r in spans.select("span", "n").collect()}  # one row for each span
    return spans, [sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)]


def _reduced(spans: DataFrame, count: int, now: dict[int, switching.Parameters]) -> dict[int, list[switching.SpanSums]]:
    """Every span's sums under each start's parameters, one job; what returns doesn't grow with a span's rows."""
    import pyarrow as pa

    def reduce(batches):
        for batch in batches:
            for span, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(values)
                found = [(start, switching.span_sums(x, p, span == 0)) for start, p in now.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([span] * len(found)), pa.array([k for k, _ in found]), pa.array([s.log for _, s in found]), *[pa.array([np.ascontiguousarray(getattr(s, c)).tobytes() for _, s in found], pa.binary()) for c in ("product", "weights", "steps")]],
                    names=["span", "start", "log", "product", "weights", "steps"],
                )

    states = len(next(iter(now.values())).means)
    empty = switching.span_sums(np.empty(0), next(iter(now.values())), False)
    out = {start: [empty] * count for start in now}
    for r in spans.select("span", "values").mapInArrow(reduce, "span long, start long, log double, product binary, weights binary, steps binary").collect():
        shaped = [np.frombuffer(r[c]).reshape(shape) for c, shape in (("product", (states,) * 2), ("weights", (states, states, 3, states)), ("steps", (states,) * 4))]
        out[r["start"]][r["span"]] = switching.SpanSums(r["log"], *shaped)
    return out


def _values_at(spans: DataFrame, sizes: list[int], rows: list[int]) -> list[float]:
    """The values of a few rows of the series by their places in it."""
    import pyarrow as pa

    begins = np.concatenate([[0], np.cumsum(sizes)])
    wanted: dict[int, list[int]] = {}
    for row in sorted(set(map(int, rows))):
        span = int(np.searchsorted(begins, row, side="right")) - 1
        wanted.setdefault(span, []).append(row - int(begins[span]))

    def pick(batches):
        for batch in batches:
            for span, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = wanted.get(span, [])
                yield pa.RecordBatch.from_arrays([pa.array([a + int(begins[span]) for a in at], pa.int64()), pa.array(np.frombuffer(values)[at])], names=["row", "value"])

    found = {r["row"]: r["value"] for r in spans.where(F.col("span").isin(list(wanted))).select("span", "values").mapInArrow(pick, "row long, value double").collect()}
    return [found[int(r)] for r in rows]


def _series_states(spans: DataFrame, sums: list[switching.SpanSums], p: switching.Parameters) -> DataFrame:
    """Rows of STATE_SCHEMA from a series' spans and the model's parameters."""
    import pyarrow as pa

    loglik, ends = switching.scan(sums, p.transition)
    durations = 1 / np.maximum(1 - np.diag(p.transition), 1e-12)

    def tell(batches):
        for batch in batches:
            for span, dates, values in zip(*(c.to_pylist() for c in batch.columns)):
                x, n = np.frombuffer(values), len(values) // 8
                filtered, smoothed = switching.probabilities(x, p, span == 0, *ends[span])
                constant = lambda v: pa.array([v] * n, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(dates, dtype=np.int32)).cast(pa.date32()), pa.array(list(smoothed), pa.list_(pa.float64())), pa.array(list(filtered), pa.list_(pa.float64())), pa.array(smoothed.argmax(axis=1).astype(np.int32)), pa.array(filtered.argmax(axis=1).astype(np.int32)),
                        pa.array(np.full(n, loglik)), constant(p.means), constant(p.sds), constant(p.transition.ravel()), constant(durations),
                    ],
                    names=[c.split()[0] for c in STATE_SCHEMA.split(", ")],
                )

    return spans.select("span", "dates", "values").mapInArrow(tell, STATE_SCHEMA)


def filter_series(returns: DataFrame, means: Sequence[float], sds: Sequence[float], transition: Sequence[Sequence[float]], span_rows: int = SPAN_ROWS) -> DataFrame:
    """State probabilities and log-likelihood of one series under a given model: rows of ``fit_regimes`` without a track. Spans are
    reduced to their products, a scan over those gives what stands before and after each, and the spans' rows follow."""
    p = switching.Parameters(np.asarray(means, dtype=float), np.asarray(sds, dtype=float), np.asarray(transition, dtype=float))
    spans, sizes = series_spans(returns, span_rows)
    if not sizes:
        return returns.sparkSession.createDataFrame([], STATE_SCHEMA)
    return _series_states(spans, _reduced(spans, len(sizes), {0: p})[0], p)


def fit_regime_series(returns: DataFrame, states: int = 2, restarts: int = 5, seed: int = 42, iterations: int = 200, span_rows: int = SPAN_ROWS) -> DataFrame:
    """``fit_regimes`` for one long series of dates that differ, cut into spans.

    A step of all starts is one job that reduces every span to numbers that don't grow with its rows; the scan over the spans
    and the new parameters are the driver's. A series of one span has no need of steps between tasks: each start is one task.
    The starts and steps are those of ``numeric.fit_switching``. An empty series gives no rows.
    """
    import pyarrow as pa

    spark = returns.sparkSession
    spans, sizes = series_spans(returns, span_rows)
    if not sizes:
        return spark.createDataFrame([], STATE_SCHEMA)
    if len(sizes) == 1:
        fan = spans.select("values", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("start")).repartition(restarts, "start")

        def fit(batches):
            for batch in batches:
                for values, start in zip(*(c.to_pylist() for c in batch.columns)):
                    _, loglik, p = switching.fit(np.frombuffer(values), states, [start], seed, iterations)
                    yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([loglik]), pa.array([np.concatenate([p.means, p.sds, p.transition.ravel()]).tobytes()], pa.binary())], names=["start", "loglik", "model"])

        best = max(fan.mapInArrow(fit, "start long, loglik double, model binary").collect(), key=lambda r: (r["loglik"], -r["start"]))  # one row for each start
        model = np.frombuffer(best["model"])
        p = switching.Parameters(model[:states], model[states : 2 * states], model[2 * states :].reshape(states, states))
    else:
        n = sum(sizes)
        mean, sd = _moments(spans)
        spread = max(sd, 1e-12)
        draws = {s: switching.start_draws(n, states, s, seed) for s in range(restarts)}
        values = _values_at(spans, sizes, [r for rows, _ in draws.values() for r in rows])
        first = {s: switching.start_parameters(s, states, mean, spread, np.array(values[s * states : (s + 1) * states]), factors) for s, (_, factors) in draws.items()}
        found = switching.maximise(first, lambda now: _reduced(spans, len(sizes), now), spread, iterations)
        p = switching.by_volatility(found[max(found, key=lambda s: (found[s][0], -s))][1])
    return _series_states(spans, _reduced(spans, len(sizes), {0: p})[0], p)


def _moments(spans: DataFrame) -> tuple[float, float]:
    """Mean and population deviation of a series, from each span's own."""
    import pyarrow as pa

    def own(batches):
        for batch in batches:
            x = [np.frombuffer(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in x]), pa.array([v.mean() for v in x]), pa.array([((v - v.mean()) ** 2).sum() for v in x])], names=["n", "m", "s"])

    parts = spans.select("values").mapInArrow(own, "n long, m double, s double")
    r = parts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum("s").alias("s")).first()
    mean = r["nm"] / r["n"]
    return mean, math.sqrt(max(0.0, (r["s"] + r["nmm"] - r["n"] * mean * mean) / r["n"]))


def since(states: DataFrame, start) -> DataFrame:
    """The model's rows from a date on; its parameters are those of the whole track, as they stand in every row."""
    return states.where(F.col("date") >= F.lit(start).cast("date"))


def probabilities_at(states: DataFrame, date, filtered: bool = True):
    """The state probabilities on the last date up to ``date``; filtered ones unless asked otherwise."""
    row = states.where(F.col("date") <= F.lit(date).cast("date")).agg(F.max_by("filtered" if filtered else "smoothed", "date")).head()
    return row[0]


def disagreement(states: DataFrame) -> DataFrame:
    """How far filtered and smoothed probabilities differ: largest difference, dates with another state, all dates."""
    diff = F.array_max(F.zip_with("smoothed", "filtered", lambda a, b: F.abs(a - b)))
    return states.agg(F.max(diff).alias("largest"), F.count_if(F.col("state") != F.col("filtered_state")).alias("reclassified"), F.count(F.lit(1)).alias("n"))


def frequencies(states: DataFrame) -> DataFrame:
    """(state, n, frequency) over the rows that have a state (not -1)."""
    counts = states.where("state >= 0").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("frequency", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def align_states(targets: DataFrame, states: DataFrame) -> DataFrame:
    """Target rows with the state of their date, -1 where there is none."""
    return targets.join(states.select("date", "state"), "date", "left").withColumn("state", F.coalesce("state", F.lit(-1)))


def volatility_states(returns: DataFrame, n_states: int = 3, window: int = 21, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """(by…, date, vol, state): trailing volatility cut at the quantiles i/n; the warm-up takes the first valid volatility.

    A value on a threshold belongs to the upper state."""
    by = list(by)
    over, all_ = frame(by, window), W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    vol = F.when(F.count(F.lit(1)).over(over) == window, F.stddev_samp("ret").over(over))
    rows = returns.select(*by, "date", "ret", vol.alias("__v")).withColumn("vol", F.coalesce("__v", F.first("__v", ignorenulls=True).over(all_))).where("vol is not null")
    cuts = rows.groupBy(*by).agg(F.percentile("vol", F.array(*[F.lit(i / n_states) for i in range(1, n_states)])).alias("__cuts"))
    joined = rows.join(F.broadcast(cuts), by)
    return joined.select(*by, "date", "ret", "vol", F.size(F.filter("__cuts", lambda c: F.col("vol") >= c)).alias("state"))


def state_statistics(rows: DataFrame, periods_per_year: int = 252, by: Sequence[str] = ()) -> DataFrame:
    """(by…, state, n, frequency, mean, volatility, ratio): null volatility for a single row; states without rows are left out."""
    live = rows.where("state >= 0")
    sums = live.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") * periods_per_year).alias("mean"), (F.stddev_samp("ret") * math.sqrt(periods_per_year)).alias("volatility"))
    total = F.sum("n").over(W.partitionBy(*(list(by) or [F.lit(1)])))
    return sums.withColumns({"frequency": F.col("n") / total, "ratio": F.try_divide("mean", "volatility")})


def state_beta(rows: DataFrame) -> DataFrame:
    """(state, n, beta) of ret on market; states with fewer than 2 rows are left out."""
    return rows.where("state >= 0").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ret", "market").alias("beta")).where("n >= 2")


def state_correlation(rows: DataFrame) -> DataFrame:
    """(state, average): the mean correlation of distinct tickers by state; states with fewer than 3 dates are left out."""
    each = pairs(rows.where("state >= 0"), ["state"]).where("a < b").groupBy("state", "a", "b").agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))
    return each.where("n >= 3").groupBy("state").agg(F.avg("rho").alias("average"))


@dataclass(frozen=True)
class RegimeState:
    """What a strategy may know of the regime at a date."""

    probabilities: tuple[float, ...]
    names: tuple[str, ...]
    fitted_through: object

    def __post_init__(self):
        if len(self.probabilities) != len(self.names):
            raise ValueError("one name for each state")
        if abs(sum(self.probabilities) - 1) > 1e-6 or min(self.probabilities) < -1e-9:
            raise ValueError("probabilities must be non-negative and sum to 1")

    @property
    def current(self) -> str:
        return self.names[int(np.argmax(self.probabilities))]

    @property
    def is_stress(self) -> bool:
        return self.current == self.names[-1] and len(self.names) > 1
