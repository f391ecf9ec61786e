"""The two feature sets, and preparation of features for fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import recurrences as rec
from tidemark.functions.frames import by_time
from tidemark.functions.scalar import null_inf, ratio

#: Fixed values, in the order in which engines take them.
CURATED = ("log_ret", "sma_200", "sma_13", "atr_20", "adx_14", "adx_inflection", "di_plus_14", "di_minus_14", "di_spread", "vstop", "vstop_trend", "vstop_interaction", "price_sma200_ratio", "price_vstop_ratio", "price_vstop_gap_atr", "sma200_distance_atr", "volume_ratio", "true_range_pct", "kdj_j")
#: What the engines with generic features are fitted on: the 49 columns of ``generic``
#: that the survey's default configuration yields. mfi_14 is not one of them.
GENERIC = ("log_ret", "simple_ret", "sma_20", "ema_20", "sma_ratio_50_200", "atr_14", "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_position", "rsi_14", "roc_10", "stoch_k_14", "stoch_d_3", "volume_sma_20", "volume_ratio_20", "obv", "vwap", "adx_14", "di_plus_14", "di_minus_14", "price_position_5", "price_position_10", "price_position_20", "hl_ratio_5", "hl_ratio_10", "hl_ratio_20", "williams_r_14", "cci_20", "adl", "vpt", "day_of_week", "day_of_month", "month", "quarter", "is_month_end", "is_month_start", "is_quarter_end", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "hour", "minute", "session", "hour_sin", "hour_cos", "is_weekend")
KEYS = ("symbol", "ts", "bar_index", "open", "high", "low", "close", "volume")


def curated(bars: DataFrame) -> DataFrame:
    """Keys and the 19 curated features."""
    # The recurrences sort most, so they come while rows are narrow.
    d = rec.kdj(rec.together(bars, rec.atr_steps(20), rec.adx_steps()))
    d = d.withColumns({"log_ret": ind.log_return(), "sma_200": ind.sma(200), "sma_13": ind.sma(13), "volume_ratio": ratio("volume", ind.sma(20, "volume")), "true_range_pct": ratio(ind.true_range(), "close")})
    d = d.withColumns({"price_sma200_ratio": ratio("close", "sma_200"), "sma200_distance_atr": ratio(F.col("close") - F.col("sma_200"), "atr_20")})
    d = rec.trailing_stop(d)
    return d.select(*KEYS, *CURATED)


def generic(bars: DataFrame) -> DataFrame:
    """Keys and the generic features: averages, channels, momentum, volume, patterns
    and calendar, with the recurrences EMA 20, ATR 14, RSI 14 and ADX 14."""
    # The recurrences sort most, so they come while rows are narrow.
    d = rec.together(bars, rec.ema_steps("ema_20", "close", 20), rec.atr_steps(14), rec.rsi_steps(), rec.adx_steps())
    d = d.withColumns({"log_ret": ind.log_return(), "simple_ret": ind.simple_return()})
    return ind.time_features(ind.volume_features(ind.momentum(ind.price_levels(ind.channels(ind.moving_averages(d))))))


def select_features(df: DataFrame, drop=KEYS) -> list[str]:
    """Numeric columns, other than ``drop``, with a value in some row: one aggregate."""
    names = [c for c, t in df.dtypes if c not in drop and t in ("double", "float", "int", "bigint", "smallint")]
    counts = df.agg(*[F.count(null_inf(F.col(c).cast("double"))).alias(c) for c in names]).first()
    return [c for c in names if counts[c]]


def backfill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls take the next value of the symbol."""
    # From the last bar down, so that a frame grows by a row at a time.
    back = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def zscore_expanding(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / (population deviation + 1e-8) of all earlier bars."""
    past = by_time().rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"z_{c}": (F.col(c) - F.avg(c).over(past)) / (F.stddev_pop(c).over(past) + 1e-8) for c in columns})


def pooled_pca(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """(component, explained, cumulative, kept): components of the panel's features,
    kept until their variance adds to ``share``."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="x").transform(df.dropna(subset=columns))
    rows = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(rows).transform(rows)
    explained = PCA(k=len(columns), inputCol="z", outputCol="p").fit(rows).explainedVariance.toArray()
    out, total = [], 0.0
    for k, e in enumerate(explained):
        out.append((k, float(e), float(total + e), bool(total < share)))
        total += e
    return df.sparkSession.createDataFrame(out, "component int, explained double, cumulative double, kept boolean")
