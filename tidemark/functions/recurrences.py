"""Ordered recurrences: y(t) = a y(t-1) + u(t), and what is built of it.

A linear recurrence is a weighted sum over the past. Inside a block of bars it is a
window sum of u(t) a^-t; blocks are as long as a^-t stays moderate, and at that
length one block's result already weighs a^length, at most 1e-30, in the one after
the next. So a value is its block's sum plus what the block before passes on, both
plain windows: nothing is folded row by row and no series has to fit in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.functions.frames import by_time
from tidemark.functions.indicators import lag, rolling, true_range
from tidemark.functions.scalar import ratio


def linear(df: DataFrame, out: str, u: Column, a: float) -> DataFrame:
    """Add ``out``: y(t) = a y(t-1) + u(t) per symbol, over the bars where u isn't
    null, y starting as the first u; null on the others."""
    block = max(2, int(30 / -math.log10(a)))
    d = df.withColumn("__linu", u)
    d = d.withColumn("__link", F.when(F.col("__linu").isNotNull(), F.count("__linu").over(by_time().rowsBetween(Window.unboundedPreceding, 0)) - 1))
    d = d.withColumns({"__linb": F.floor(F.col("__link") / block), "__linj": F.pmod(F.col("__link"), F.lit(block)).cast("double")})
    inside = Window.partitionBy("symbol", "__linb").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__linz", F.sum(F.col("__linu") * F.pow(F.lit(1 / a), F.col("__linj"))).over(inside) * F.pow(F.lit(a), F.col("__linj")))
    before = Window.partitionBy("symbol").orderBy("__linb").rangeBetween(-1, -1)
    d = d.withColumn("__linp", F.max(F.struct("__link", "__linz")).over(before)["__linz"])
    y = F.when(F.col("__link").isNotNull(), F.col("__linz") + F.coalesce(F.col("__linp"), F.lit(0.0)) * F.pow(F.lit(a), F.col("__linj") + 1))
    return d.withColumn(out, y).drop("__linu", "__link", "__linb", "__linj", "__linz", "__linp")


def together(df: DataFrame, *indicators) -> DataFrame:
    """Indicators given as functions of a frame that yield (frame, {column: (u, a)}) for
    each round of recurrences that they need, and return the frame in the end."""
    asked, running = {}, []
    for make in indicators:
        steps = make(df)
        df, wanted = next(steps)
        asked |= wanted
        running.append(steps)
    while running:
        df, asked, left = linear_many(df, asked), {}, []
        for steps in running:
            try:
                df, wanted = steps.send(df)
                asked |= wanted
                left.append(steps)
            except StopIteration as end:
                df = end.value
        running = left
    return df


#: Weights inside a block go up to 10 to this power, and what a block passes on to the
#: one after next is below 10 to the other one.
LARGEST, LEAST = 250, -20


def linear_many(df: DataFrame, series: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add a column per series: y(t) = a y(t-1) + u(t), over the bars where u isn't null.
    A series here has no gaps, which would count as steps: after its first value all are
    there (``linear`` takes gaps). Blocks are cut by bar, so all series share the windows;
    very unlike ones are worked out apart."""
    order = sorted(series, key=lambda k: series[k][1])
    digits = {k: -math.log10(series[k][1]) for k in order}
    if LEAST / -digits[order[-1]] > LARGEST / digits[order[0]]:
        half = len(order) // 2
        return linear_many(linear_many(df, {k: series[k] for k in order[:half]}), {k: series[k] for k in order[half:]})
    block = int(math.sqrt((LEAST / -digits[order[-1]]) * (LARGEST / digits[order[0]]))) + 1
    own = lambda k, kind: f"__{kind}_{k}"
    at = F.row_number().over(by_time()) - 1
    d = df.withColumns({own(k, "u"): u for k, (u, _) in series.items()} | {"__block": F.floor(at / block), "__at": F.pmod(at, F.lit(block)).cast("double")})
    inside = Window.partitionBy("symbol", "__block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda a, x: F.pow(F.lit(a), x)
    d = d.withColumns({own(k, "z"): F.sum(F.col(own(k, "u")) * power(1 / a, F.col("__at"))).over(inside) * power(a, F.col("__at")) for k, (_, a) in series.items()})
    before = Window.partitionBy("symbol").orderBy("__block").rangeBetween(-1, -1)
    last = {own(k, "p"): F.max(F.struct("__at", own(k, "z"))).over(before)[own(k, "z")] for k in series}
    d = d.withColumns(last)
    value = lambda k, a: F.when(F.col(own(k, "u")).isNotNull(), F.col(own(k, "z")) + F.coalesce(own(k, "p"), F.lit(0.0)) * power(a, F.col("__at") + 1))
    d = d.withColumns({k: value(k, a) for k, (_, a) in series.items()})
    return d.drop("__block", "__at", *[own(k, kind) for k in series for kind in "uzp"])


def _nth(x: Column) -> Column:
    """Number, from 1, of a value among the values that aren't null so far."""
    return F.count(x).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def _ema(x: str, n: int, alpha: float | None = None) -> tuple[Column, float]:
    """Recursive exponential mean of a column, from its first value."""
    alpha = alpha or 2 / (n + 1)
    return F.when(_nth(F.col(x)) == 1, F.col(x)).otherwise(alpha * F.col(x)), 1 - alpha


def _from(n: int, x: str, y: str) -> Column:
    """``y`` from the n-th value of x on."""
    return F.when(_nth(F.col(x)) >= n, F.col(y))


def _wilder(x: str, n: int) -> tuple[Column, float]:
    """Wilder's smoothing: the mean of the first n bars' values at bar n, then
    y += (x - y) / n. Null before bar n."""
    at = F.row_number().over(by_time())
    seed = F.avg(x).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(at == n, seed).when(at > n, F.col(x) / n), 1 - 1 / n


def ema_steps(out: str, x: str, n: int, alpha: float | None = None):
    def steps(df):
        df = yield df, {out: _ema(x, n, alpha)}
        return df.withColumn(out, _from(n, x, out))

    return steps


def ema(df: DataFrame, out: str, x: str, n: int, alpha: float | None = None) -> DataFrame:
    """Recursive exponential mean over a column's values, from its first; null before n of
    them and where there is none."""
    return linear(df, out, *_ema(x, n, alpha)).withColumn(out, _from(n, x, out))


def ewm_adjusted(df: DataFrame, out: str, x: str, span: int) -> DataFrame:
    """Exponential mean over a column's values, whose weights add to 1 from the first on."""
    a = 1 - 2 / (span + 1)
    d = linear(df, "__num", F.col(x), a)
    d = d.withColumn("__n", _nth(F.col(x)))
    return d.withColumn(out, F.col("__num") * (1 - a) / (1 - F.pow(F.lit(a), F.col("__n")))).drop("__num", "__n")


def wilder(df: DataFrame, out: str, x: str, n: int) -> DataFrame:
    return linear(df, out, *_wilder(x, n))


def atr_steps(n: int):
    def steps(df):
        df = yield df.withColumn("__tr_atr", true_range()), {f"atr_{n}": _wilder("__tr_atr", n)}
        return df.drop("__tr_atr")

    return steps


def atr(df: DataFrame, n: int) -> DataFrame:
    return together(df, atr_steps(n))


def rsi_steps(n: int = 14):
    def steps(df):
        step = F.col("close") - lag("close")
        df = df.withColumns({"__rise": F.greatest(F.coalesce(step, F.lit(0.0)), F.lit(0.0)), "__fall": F.greatest(F.coalesce(-step, F.lit(0.0)), F.lit(0.0))})
        df = yield df, {"__r": _ema("__rise", n, 1 / n), "__f": _ema("__fall", n, 1 / n)}
        r, f = _from(n, "__rise", "__r"), _from(n, "__fall", "__f")
        df = df.withColumns({"__r": r, "__f": f})
        return df.withColumn(f"rsi_{n}", F.when(F.col("__f") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("__r", "__f")))).drop("__rise", "__fall", "__r", "__f")

    return steps


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength index from Wilder-weighted rises and falls."""
    return together(df, rsi_steps(n))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    d = linear(linear(df, "__fast", *_ema("close", fast)), "__slow", *_ema("close", slow))
    d = d.withColumn("macd", _from(fast, "close", "__fast") - _from(slow, "close", "__slow"))
    return ema(d, "macd_signal", "macd", signal).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow")


def directional_movement(df: DataFrame) -> DataFrame:
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    return df.withColumns({"dm_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "dm_minus": F.when((down > up) & (down > 0), down).otherwise(0.0)})


def adx_steps(n: int = 14):
    def steps(df):
        df = directional_movement(df).withColumn("__tr", true_range())
        df = yield df, {"__t": _wilder("__tr", n), "__p": _wilder("dm_plus", n), "__m": _wilder("dm_minus", n)}
        di = lambda c: F.when(F.col("__t") == 0, 0.0).otherwise(100 * F.try_divide(c, "__t"))
        df = df.withColumns({f"di_plus_{n}": di(F.col("__p")), f"di_minus_{n}": di(F.col("__m"))})
        total = F.col(f"di_plus_{n}") + F.col(f"di_minus_{n}")
        df = df.withColumns({"di_spread": F.col(f"di_plus_{n}") - F.col(f"di_minus_{n}"), "__dx": F.when(total == 0, 0.0).otherwise(100 * F.abs(F.col(f"di_plus_{n}") - F.col(f"di_minus_{n}")) / total)})
        df = yield df, {f"adx_{n}": _wilder("__dx", n)}
        return df.withColumn("adx_inflection", F.col(f"adx_{n}") - lag(f"adx_{n}")).drop("__tr", "__t", "__p", "__m", "__dx", "dm_plus", "dm_minus")

    return steps


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's directional indicators, their spread, ADX and its one-bar change."""
    return together(df, adx_steps(n))


def keltner(df: DataFrame, span: int = 20, n: int = 10, k: float = 2.0) -> DataFrame:
    d = ewm_adjusted(df.withColumn("__tr", true_range()), "keltner_middle", "close", span)
    width = k * rolling(F.avg, F.col("__tr"), n, min(n, 10))
    return d.withColumns({"keltner_upper": F.col("keltner_middle") + width, "keltner_lower": F.col("keltner_middle") - width}).drop("__tr")


def chaikin_volatility(df: DataFrame, span: int = 10, back: int = 10) -> DataFrame:
    d = ewm_adjusted(df.withColumn("__hl", F.col("high") - F.col("low")), "__e", "__hl", span)
    return d.withColumn(f"chaikin_vol_{span}_{back}", ratio(F.col("__e") - lag("__e", back), lag("__e", back)) * 100).drop("__hl", "__e")


def kdj(df: DataFrame, n: int = 9, smooth: int = 3) -> DataFrame:
    """The J line: 3K - 2D of doubly smoothed RSV; null where RSV is."""
    low, high = rolling(F.min, F.col("low"), n), rolling(F.max, F.col("high"), n)
    d = df.withColumn("__rsv", ratio(F.col("close") - low, high - low) * 100)
    # RSV has gaps, where a range is 0.
    for out, x in (("__kk", "__rsv"), ("__dd", "__kk")):
        d = linear(d, out, *_ema(x, 1, 1 / smooth))
    return d.withColumn("kdj_j", 3 * F.col("__kk") - 2 * F.col("__dd")).drop("__rsv", "__kk", "__dd")


def vstop(df: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """Volatility stop on SMA 13 and ATR 20: a trailing stop that turns when crossed."""
    return trailing_stop(atr(df.withColumn("sma_13", rolling(F.avg, F.col("close"), 13)), 20), multiplier)


def trailing_stop(d: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """``vstop`` of bars that have sma_13 and atr_20 already. The stop depends on all
    earlier turns, so a symbol's bars are folded in order by the grouped task;
    everything else is windows."""
    schema = StructType([*d.schema, StructField("vstop", DoubleType()), StructField("vstop_trend", IntegerType())])

    def fold(table):
        import pyarrow as pa

        table = table.sort_by("ts")
        trend, edge, stop, stops, trends = 0, 0.0, 0.0, [], []
        for mean, width in zip(table["sma_13"].to_pylist(), table["atr_20"].to_pylist(), strict=True):
            if mean is None or width is None:
                stops.append(None)
                trends.append(0)
                continue
            width *= multiplier
            if trend == 0:
                trend, edge, stop = 1, mean, mean - width
            else:
                edge = max(edge, mean) if trend > 0 else min(edge, mean)
                stop = max(stop, edge - width) if trend > 0 else min(stop, edge + width)
                if (mean - stop) * trend < 0:
                    trend, edge, stop = -trend, mean, mean + trend * width
            stops.append(stop)
            trends.append(trend)
        return table.append_column("vstop", pa.array(stops, pa.float64())).append_column("vstop_trend", pa.array(trends, pa.int32()))

    d = d.groupBy("symbol").applyInArrow(fold, schema)
    return d.withColumns({"vstop_interaction": F.signum(F.col("close") - F.col("vstop")) * F.col("vstop_trend"), "price_vstop_ratio": ratio("close", "vstop"), "price_vstop_gap_atr": ratio(F.col("close") - F.col("vstop"), "atr_20")})
