"""Prefix scans and sliding windows over monoids, for tracks too long for one task and windows too wide for one row.

*Prefix scan*: rows are cut into spans of time, a deterministic expression of their date or time, so no span is found by
sampling. Windows run within spans; one aggregation sums a span up; a window over the spans of a track (one row each) gives
what each carries over; a join brings that to the rows. No task holds a track.

*Sliding window*: a window of w rows is the end of one block of w rows and the beginning of the next. Both are running
windows, so each row costs the same whatever w is. No row holds its window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from marlstone.staging import staged

#: Days of a span.
SPAN_DAYS = 1024
SPAN, CARRIES = "__span", "__carries"


def span_of(rows: DataFrame, order: str, days: float = SPAN_DAYS) -> Column:
    """The number of the span of days that a date, time or number of days lies in."""
    kind = rows.schema[order].dataType
    if isinstance(kind, T.DateType):
        at = F.unix_date(order)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        at = F.unix_micros(F.col(order).cast("timestamp")) / 86_400_000_000
    else:
        at = F.col(order)
    return F.floor(at / F.lit(days)).cast("long")


def prefix_scan(rows: DataFrame, by: Sequence[str], order: str, local: dict[str, Callable], totals: dict[str, Column], carries: dict[str, Callable], combined: dict[str, Column]) -> DataFrame:
    """``rows`` (with a column ``__span``) and the columns of ``combined``.

    ``local``: name -> function of the running window within a span; later names may use earlier ones. ``totals``: name ->
    aggregate of a span's rows and local columns. ``carries``: name -> function of the window over the spans before, of the
    totals and earlier carries; null before the first. ``combined``: name -> expression of local columns and carries.
    """
    by = list(by)
    inside = W.partitionBy(*by, SPAN).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    for name, f in local.items():
        rows = rows.withColumn(name, f(inside))
    spans = rows.groupBy(*by, SPAN).agg(*[c.alias(n) for n, c in totals.items()])
    before = W.partitionBy(*(by or [F.lit(1)])).orderBy(SPAN).rowsBetween(W.unboundedPreceding, -1)  # a row for each span of a track
    for name, f in carries.items():
        spans = spans.withColumn(name, f(before))
    joined = rows.join(spans.select(*by, SPAN, *carries), [*by, SPAN])
    return joined.select(*[c for c in rows.columns if c not in local], *[c.alias(n) for n, c in combined.items()])


def growth_scan(returns: DataFrame, by: Sequence[str] = (), order: str = "date", ret: str = "ret", days: float = SPAN_DAYS) -> DataFrame:
    """``growth``, ``peak`` and ``drawdown`` as ``performance.growth`` has them, and ``below``, the number of rows since the
    last one at its peak, by spans."""
    by = list(by)
    rows = returns.withColumn(SPAN, span_of(returns, order, days))
    rows = prefix_scan(
        rows, by, order,
        local={"__g": lambda w: F.product(1 + F.col(ret)).over(w), "__m": lambda w: F.max("__g").over(w), "__i": lambda w: F.count(F.lit(1)).over(w)},
        totals={"__total": F.max_by("__g", order), "__high": F.max("__m"), "__rows": F.count(F.lit(1))},
        carries={"__before": lambda w: F.coalesce(F.product("__total").over(w), F.lit(1.0)), "__peak": lambda w: F.max(F.col("__before") * F.col("__high")).over(w), "__past": lambda w: F.coalesce(F.sum("__rows").over(w), F.lit(0))},
        combined={"growth": F.col("__before") * F.col("__g"), "peak": F.greatest("__peak", F.col("__before") * F.col("__m")), "__at": F.col("__past") + F.col("__i")},
    )
    rows = rows.withColumn("drawdown", F.col("growth") / F.col("peak") - 1)
    top = F.when(F.col("drawdown") >= 0, F.col("__at"))
    rows = prefix_scan(
        rows, by, order,
        local={"__top": lambda w: F.max(top).over(w)},
        totals={"__last": F.max("__top")},
        carries={"__since": lambda w: F.max("__last").over(w)},
        combined={"below": F.col("__at") - F.coalesce("__top", "__since", F.lit(0))},
    )
    return rows.drop(SPAN, "__at")


def _blocks(rows: DataFrame, by: Sequence[str], order: str, window: int) -> DataFrame:
    """Rows with their place in their block of ``window`` rows and the block's number."""
    place = F.row_number().over(W.partitionBy(*(list(by) or [F.lit(1)])).orderBy(order)) - 1
    return rows.withColumn("__at", place).withColumns({"__block": F.floor(F.col("__at") / window), "__in": F.pmod("__at", F.lit(window))})


def _frames(by: Sequence[str], order: str):
    """(running window in a block, the same from the block's end, the track)."""
    block = W.partitionBy(*by, "__block")
    first, back = (block.orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(order), F.desc(order)))
    return first, back, W.partitionBy(*(list(by) or [F.lit(1)])).orderBy(order)


def sliding_drawdown(returns: DataFrame, window: int, by: Sequence[str] = ("ticker",), order: str = "date", ret: str = "ret") -> DataFrame:
    """``max_drawdown`` of each full window, whose peak starts anew with the window.

    With C the growth within blocks, a window that starts in one block and ends in the next has the worst of three: the worst
    in the first part, the worst in the second, and the second's lowest C, times the first block's whole growth, over the
    first part's highest C. A window that is a block has its own worst."""
    first, back, track = _frames(by, order)
    rows = _blocks(returns, by, order, window)
    rows = rows.withColumn("__c", F.product(1 + F.col(ret)).over(first))
    rows = rows.withColumns({"__low": F.min("__c").over(first), "__peak": F.max("__c").over(first)}).withColumn("__worst", F.min(F.col("__c") / F.col("__peak") - 1).over(first))
    rows = rows.withColumns({"__high_after": F.max("__c").over(back), "__low_after": F.min("__c").over(back), "__whole": F.first("__c").over(back)})
    rows = rows.withColumn("__worst_after", F.min(F.col("__low_after") / F.col("__c") - 1).over(back))
    of_start = {c: F.lag(c, window - 1).over(track) for c in ("__worst_after", "__high_after", "__whole")}
    rows = rows.withColumns({c + "_s": v for c, v in of_start.items()})
    across = F.least("__worst_after_s", "__worst", F.col("__low") * F.col("__whole_s") / F.col("__high_after_s") - 1)
    found = F.when(F.col("__in") == window - 1, F.col("__worst")).otherwise(across)
    return rows.where(F.col("__at") >= window - 1).select(*returns.columns, F.least(found, F.lit(0.0)).alias("max_drawdown"))


def sliding_ewma(rows: DataFrame, value: Column, window: int, decay: float, by: Sequence[str], order: str = "date", name: str = "ewma") -> DataFrame:
    """``name``: the mean of a value over each full window, with weights that fall by ``decay`` from its last row on.

    Weights within a block are powers of ``decay`` from its ends; a window of more rows than doubles can hold such powers of
    is an error."""
    if not 0 < decay <= 1 or (window - 1) * -math.log(decay) > 600:
        raise ValueError("the decay's power at the window's first row is no longer a double")
    first, back, track = _frames(by, order)
    rows_ = _blocks(rows, by, order, window).withColumn("__x", value)
    rising = F.pow(F.lit(1 / decay), F.col("__in"))
    ahead = F.sum(F.col("__x") * rising).over(first) / rising
    falling = F.pow(F.lit(decay), F.lit(window - 1) - F.col("__in"))
    rows_ = rows_.withColumns({"__first": ahead, "__rest": F.sum(F.col("__x") * falling).over(back)})
    rows_ = rows_.withColumn("__rest_s", F.lag("__rest", window - 1).over(track))
    norm = sum(decay**k for k in range(window))
    found = F.when(F.col("__in") == window - 1, F.col("__first")).otherwise(F.col("__first") + F.col("__rest_s") * F.pow(F.lit(decay), F.col("__in") + 1))
    return rows_.where(F.col("__at") >= window - 1).select(*rows.columns, (found / norm).alias(name))


#: Size of the sketches that bracket a quantile, the ranks that they are asked for, and how many of these the bracket leaves on
#: each side: some times the sketches' error.
SKETCH, GRID, MARGIN = 2048, 400, 3


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, q: float, most: int = 1_000_000) -> DataFrame:
    """(by…, n, quantile): each track's quantile, as ``percentile`` gives it, by bracket and selection.

    A mergeable sketch brackets the two order statistics between which the quantile lies, the bracket's counts are checked, and
    the values in it are counted, equal ones together. A bracket of more than ``most`` rows is narrowed again. Null and NaN
    values don't count; a track without values has none.
    """
    by = list(by)
    key = by or ["__all"]
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("__v"))
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    ends = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    ends = ends.withColumns({"__k": F.floor((F.col("n") - 1) * F.lit(q)).cast("long"), "__below": F.lit(0).cast("long")}).withColumn("__in", F.col("n"))
    ends = ends.withColumn("__next", F.least(F.col("__k") + 1, F.col("n") - 1))
    inside = rows.join(ends, key).where("__v BETWEEN __lo AND __hi")
    while True:
        sketches = inside.groupBy(*key).agg(F.kll_sketch_agg_double("__v", F.lit(SKETCH)).alias("__s"))
        sketches = sketches.select(*key, F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])).alias("__g"))  # ranks must be constants: a grid of them
        place = lambda k, step: F.least(F.lit(GRID), F.greatest(F.lit(0), F.floor((F.col(k) - F.col("__below")) / F.col("__in") * GRID).cast("int") + step))
        cut = ends.join(sketches, key).withColumns({"__a": F.get("__g", place("__k", -MARGIN)), "__b": F.get("__g", place("__next", MARGIN + 1))}).drop("__g")
        # Sketches are random: the counts go with the ends that they were counted for, in one aggregation.
        cut = rows.join(cut, key).groupBy(*key, "n", "__k", "__next", "__lo", "__hi", "__below", "__in", "__a", "__b").agg(F.count_if(F.expr("__v < __a")).alias("__less"), F.count_if(F.expr("__v BETWEEN __a AND __b")).alias("__within"))
        held = (F.col("__less") <= F.col("__k")) & (F.col("__less") + F.col("__within") > F.col("__next"))  # a sketch may err; the old bracket stays then
        new = {"__lo": "__a", "__hi": "__b", "__below": "__less", "__in": "__within"}
        cut = cut.withColumn("__smaller", held & (F.col("__within") < F.col("__in")))
        ends = staged(cut.select(*key, "n", "__k", "__next", "__smaller", *[F.when(held, F.col(c)).otherwise(F.col(o)).alias(o) for o, c in new.items()]), "quantile-brackets")
        inside = rows.join(ends.drop("__smaller"), key).where("__v BETWEEN __lo AND __hi")
        if ends.where((F.col("__in") > most) & F.col("__smaller")).isEmpty():
            break
    values = inside.groupBy(*key, "n", "__k", "__next", "__below", "__v").agg(F.count(F.lit(1)).alias("__c"))
    values = values.withColumn("__upto", F.col("__below") + F.sum("__c").over(W.partitionBy(*key).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
    at = {"__a": F.min(F.when(F.col("__upto") > F.col("__k"), F.col("__v"))), "__b": F.min(F.when(F.col("__upto") > F.col("__next"), F.col("__v")))}
    found = values.groupBy(*key, "n", "__k").agg(*[c.alias(n) for n, c in at.items()])
    return found.select(*by, "n", (F.col("__a") + (F.col("__b") - F.col("__a")) * ((F.col("n") - 1) * F.lit(q) - F.col("__k"))).alias("quantile"))
