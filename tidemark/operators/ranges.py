"""A symbol's bars in ranges of time, so that one symbol's windows use many tasks.

The windows of this library are by symbol. Here a symbol becomes (symbol, range), each
range with a halo: the bars just before it, copied from its neighbour. What looks back
at most as far as the halo is then right on a range's own bars. Running totals start
anew in each range and get the totals of the ranges before, one row per range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import running
from tidemark.functions.indicators import typical
from tidemark.functions.scalar import ratio
from tidemark.operators import backtest, features

#: Bars in a range, and in its halo. With 4,096 bars of halo a recurrence with a span up
#: to 220 has forgotten what came before to 1e-16 of it.
ROWS, HALO = 262_144, 4_096


def numbered(bars: DataFrame, at: str = "bar_index", rows: int = ROWS) -> DataFrame:
    """Number each symbol's bars by ts from 0 without bringing them together: they are
    dealt to slots of equal time, about ``rows`` bars each, numbered there, and slots
    get the counts of those before. Bars that crowd in time share a slot."""
    stamp = F.unix_micros("ts")
    spans = bars.groupBy("symbol").agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"), F.count("*").alias("n"))
    spans = spans.select("symbol", "first", F.greatest(F.lit(1.0), (F.col("last") - F.col("first") + 1) / F.ceil(F.col("n") / rows)).alias("width"))
    slotted = bars.drop(at).join(spans, "symbol").withColumn("slot", F.floor((stamp - F.col("first")) / F.col("width"))).drop("first", "width")
    counts = slotted.groupBy("symbol", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("symbol").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("symbol", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("symbol", "slot").orderBy("ts")) - 1
    return slotted.withColumn("here", here).join(counts, ["symbol", "slot"]).withColumn(at, (F.col("before") + F.col("here")).cast("int")).drop("slot", "here", "before")


def in_ranges(bars: DataFrame, make: Callable[[DataFrame], DataFrame], sums: tuple[str, ...] = (), at: str = "bar_index", rows: int = ROWS, halo: int = HALO) -> DataFrame:
    """``make(bars)``, worked out in ranges of ``rows`` bars by ``at``, a symbol's bar
    numbers without gaps. ``make`` must keep symbol and ``at``, partition by symbol, and
    look back at most ``halo`` bars, but for the columns ``sums``, which are running
    totals over all earlier bars of a symbol; nulls in them add nothing."""
    if not 0 < halo <= rows:
        raise ValueError("a halo has at least one bar and at most as many as a range")
    own = F.floor(F.col(at) / rows)
    copies = F.when(F.pmod(F.col(at), F.lit(rows)) >= rows - halo, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = bars.withColumn("range", F.explode(copies)).withColumn("symbol", F.struct("symbol", "range")).drop("range")
    made = make(dealt)
    begins = F.col("symbol.range") * rows
    if not sums:
        return made.where(F.col(at) >= begins).withColumn("symbol", F.col("symbol.symbol"))
    # A range adds what its totals grow by on its own bars; the halo's part is taken off.
    ends = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))), F.lit(0.0)).alias(f"end_{k}") for k, c in enumerate(sums)]
    inner = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(at) < begins), F.col(at))), F.lit(0.0)).alias(f"halo_{k}") for k, c in enumerate(sums)]
    each = made.groupBy("symbol").agg(*ends, *inner)
    before = Window.partitionBy("symbol.symbol").orderBy("symbol.range").rowsBetween(Window.unboundedPreceding, -1)
    add = [(F.coalesce(F.sum(F.col(f"end_{k}") - F.col(f"halo_{k}")).over(before), F.lit(0.0)) - F.col(f"halo_{k}")).alias(f"add_{k}") for k in range(len(sums))]
    offsets = each.select("symbol", *add)
    out = made.where(F.col(at) >= begins).join(offsets, "symbol")
    out = out.withColumns({c: F.col(c) + F.col(f"add_{k}") for k, c in enumerate(sums)}).drop(*[f"add_{k}" for k in range(len(sums))])
    return out.withColumn("symbol", F.col("symbol.symbol"))


def generic(bars: DataFrame, rows: int = ROWS, halo: int = HALO) -> DataFrame:
    """``features.generic`` in ranges."""

    def make(d: DataFrame) -> DataFrame:
        out = features.generic(d)
        return out.withColumns({"paid": F.sum(typical() * F.col("volume")).over(running()), "traded": F.sum("volume").over(running())})

    out = in_ranges(bars, make, ("obv", "adl", "vpt", "paid", "traded"), "bar_index", rows, halo)
    return out.withColumn("vwap", ratio("paid", "traded")).drop("paid", "traded")


def equity(positions: DataFrame, min_train: int = 252, rows: int = ROWS, halo: int = 1) -> DataFrame:
    """``backtest.equity`` of ``positions(symbol, ret_index, ret, position)`` in ranges:
    totals of the factors' logs, of the negative ones and of zeros."""

    def make(d: DataFrame) -> DataFrame:
        d = d.withColumn("pnl", backtest.pnl())
        return d.withColumns({name: F.sum(c).over(Window.partitionBy("symbol").orderBy("ret_index").rowsBetween(Window.unboundedPreceding, 0)) for name, c in backtest.factors().items()})

    out = in_ranges(positions, make, backtest.FACTORS, "ret_index", rows, halo)
    return out.withColumn("equity", F.when(F.col("ret_index") >= min_train, backtest.product())).drop(*backtest.FACTORS)
