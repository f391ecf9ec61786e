"""Technical indicators as window expressions over bars.

All frames share (symbol, ts), so Spark sorts a symbol once. ``mp`` is the number
of values a frame needs; fewer give null. Divisions by zero give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import by_time, running
from tidemark.functions.scalar import calendar, cyclical, intraday, ratio

MIN_PERIODS = 10


def frame(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def rolling(agg, x: Column, n: int, mp: int | None = None) -> Column:
    """``agg`` of ``x`` over the last n bars, null below ``mp`` values (n by default)."""
    return F.when(F.count(x).over(frame(n)) >= (n if mp is None else mp), agg(x).over(frame(n)))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def simple_return() -> Column:
    return ratio("close", lag("close")) - 1


def log_return() -> Column:
    return F.ln(ratio("close", lag("close")))


def sma(n: int, x: str = "close", mp: int | None = None) -> Column:
    return rolling(F.avg, F.col(x), n, mp)


def wma(x: Column, n: int) -> Column:
    """Linearly weighted mean of n values, the last one weighing n."""
    total = sum((F.lag(x, n - k).over(by_time()) * k for k in range(1, n)), x * n)
    return total / (n * (n + 1) / 2)


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def change(x: str, n: int) -> Column:
    return ratio(F.col(x) - lag(x, n), lag(x, n)) * 100


def moving_averages(bars: DataFrame, tma: int = 20, wma_n: int = 10, hma: int = 16) -> DataFrame:
    """SMAs and their ratio, triangular, weighted and Hull averages."""
    half, root, close = hma // 2, int(math.sqrt(hma)), F.col("close")
    out = bars.withColumns({"sma_20": sma(20), "sma_13": sma(13), "sma_200": sma(200), "sma_ratio_50_200": ratio(sma(50), sma(200)), "__half": sma(tma // 2, mp=min(MIN_PERIODS, tma // 2)), f"wma_{wma_n}": wma(close, wma_n), "__hull": 2 * wma(close, half) - wma(close, hma)})
    return out.withColumns({f"tma_{tma}": rolling(F.avg, F.col("__half"), tma // 2, min(MIN_PERIODS, tma // 2)), f"hma_{hma}": wma(F.col("__hull"), root)}).drop("__half", "__hull")


def channels(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """True range and its simple mean, Bollinger bands, Donchian channel, historical
    volatility. A band's width is in percent of the middle, and the position divides
    by that width."""
    sd = rolling(F.stddev_pop, F.col("close"), n)
    out = bars.withColumns({"true_range": true_range(), "__lr": log_return(), "bb_middle": sma(n), "__sd": sd})
    upper, lower = F.col("bb_middle") + k * F.col("__sd"), F.col("bb_middle") - k * F.col("__sd")
    width = ratio(upper - lower, "bb_middle") * 100
    dmp = lambda f, c: rolling(f, F.col(c), n, MIN_PERIODS)
    out = out.withColumns({
        "true_range_pct": ratio("true_range", "close"), "atr_sma_14": rolling(F.avg, F.col("true_range"), 14, MIN_PERIODS),
        "bb_upper": upper, "bb_lower": lower, "bb_width": width, "bb_position": ratio(F.col("close") - lower, width),
        "donchian_upper": dmp(F.max, "high"), "donchian_lower": dmp(F.min, "low"), "hist_vol": rolling(F.stddev_samp, F.col("__lr"), n, MIN_PERIODS) * math.sqrt(252),
    })
    return out.withColumn("donchian_middle", (F.col("donchian_upper") + F.col("donchian_lower")) / 2).drop("__lr", "__sd")


def price_levels(bars: DataFrame) -> DataFrame:
    """Where the close lies in the range of 5, 10 and 20 bars, and that range's ratio."""
    columns = {}
    for n in (5, 10, 20):
        mp = min(MIN_PERIODS, n)
        low, high = rolling(F.min, F.col("low"), n, mp), rolling(F.max, F.col("high"), n, mp)
        columns |= {f"price_position_{n}": ratio(F.col("close") - low, high - low), f"hl_ratio_{n}": ratio(high, low)}
    return bars.withColumns(columns)


def momentum(bars: DataFrame) -> DataFrame:
    """ROC, momentum, stochastic, Williams %R, CCI, money flow, Aroon, simple DMI."""
    hh, ll = rolling(F.max, F.col("high"), 14), rolling(F.min, F.col("low"), 14)
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    out = bars.withColumns({"__tp": typical(), "__tr": true_range(), "__up": F.when(up > down, F.greatest(up, F.lit(0.0))).otherwise(0.0), "__down": F.when(down > up, F.greatest(down, F.lit(0.0))).otherwise(0.0)})
    tp = F.col("__tp")
    mean = lambda n: rolling(F.avg, tp, n, MIN_PERIODS)
    out = out.withColumns({
        "roc_10": change("close", 10), "mtm_10": F.col("close") - lag("close", 10), "proc_12": change("close", 12),
        "stoch_k_14": ratio(F.col("close") - ll, hh - ll) * 100, "williams_r_14": ratio(hh - F.col("close"), hh - ll) * -100,
        "__mean": mean(20), "__tps": F.collect_list("__tp").over(frame(20)), "__in": F.when(tp > lag("__tp"), tp * F.col("volume")).otherwise(0.0), "__out": F.when(tp < lag("__tp"), tp * F.col("volume")).otherwise(0.0),
        "__highs": F.collect_list("high").over(frame(25)), "__lows": F.collect_list("low").over(frame(25)),
        "__atr": rolling(F.avg, F.col("__tr"), 14, MIN_PERIODS), "__dmp": rolling(F.avg, F.col("__up"), 14, MIN_PERIODS), "__dmn": rolling(F.avg, F.col("__down"), 14, MIN_PERIODS),
    })
    deviation = F.aggregate(F.transform("__tps", lambda x: F.abs(x - F.col("__mean"))), F.lit(0.0), lambda a, x: a + x) / F.size("__tps")
    flow = ratio(rolling(F.sum, F.col("__in"), 14, MIN_PERIODS), rolling(F.sum, F.col("__out"), 14, MIN_PERIODS))
    since = lambda xs, best: F.when(F.size(xs) >= MIN_PERIODS, (24.0 - (F.array_position(xs, best(xs)) - 1)) / 24.0 * 100)
    out = out.withColumns({
        "stoch_d_3": rolling(F.avg, F.col("stoch_k_14"), 3), "cci_20": ratio(tp - F.col("__mean"), 0.015 * deviation), "mfi_14": 100 - ratio(F.lit(100.0), 1 + flow),
        "aroon_up_25": since(F.col("__highs"), F.array_max), "aroon_down_25": since(F.col("__lows"), F.array_min),
        "dmi_plus_14": ratio("__dmp", "__atr") * 100, "dmi_minus_14": ratio("__dmn", "__atr") * 100,
    })
    out = out.withColumns({"aroon_oscillator_25": F.col("aroon_up_25") - F.col("aroon_down_25"), "__dx": ratio(F.abs(F.col("dmi_plus_14") - F.col("dmi_minus_14")), F.col("dmi_plus_14") + F.col("dmi_minus_14")) * 100})
    out = out.withColumn("dmi_adx_14", rolling(F.avg, F.col("__dx"), 14, MIN_PERIODS))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def volume_features(bars: DataFrame) -> DataFrame:
    """Volume mean and ratio, OBV, VWAP, accumulation, VPT, ease of movement, ROC."""
    step = F.col("close") - lag("close")
    mid = (F.col("high") + F.col("low")) / 2
    out = bars.withColumns({"volume_sma_20": sma(20, "volume", MIN_PERIODS), "__tp": typical(), "__ret": ratio(step, lag("close")), "__sign": F.signum(step) * F.col("volume"), "__mfv": F.coalesce(ratio(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low")), F.lit(0.0)) * F.col("volume"), "__mid": mid})
    out = out.withColumn("__eom", ratio(F.col("__mid") - lag("__mid"), F.col("high") - F.col("low")))
    return out.withColumns({
        "volume_ratio_20": ratio("volume", "volume_sma_20"), "obv": F.sum("__sign").over(running()),
        "vwap": ratio(F.sum(F.col("__tp") * F.col("volume")).over(running()), F.sum("volume").over(running())), "adl": F.sum("__mfv").over(running()),
        "vpt": F.sum(F.col("__ret") * F.col("volume")).over(running()), "eom_14": rolling(F.avg, F.col("__eom"), 14, MIN_PERIODS), "volume_roc_10": change("volume", 10),
    }).drop("__tp", "__ret", "__sign", "__mfv", "__mid", "__eom")


def time_features(bars: DataFrame) -> DataFrame:
    return bars.withColumns(calendar() | cyclical() | intraday())
