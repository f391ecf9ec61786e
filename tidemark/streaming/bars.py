"""Streaming bars and regimes: tumbling OHLCV windows, and labels with held state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = "symbol string, ts timestamp, ret double, regime int"


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV per symbol and window of ``ticks(symbol, ts, price, size)``; ticks later
    than the watermark are left out, and a bar is final when it passes."""
    order = F.struct("ts", "price")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    out = bars.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_regimes(bars: DataFrame, window: int = 20, threshold: float = 0.05) -> DataFrame:
    """Threshold labels of ``bars(symbol, ts, close)`` that arrive in order per symbol;
    a symbol's state is its last close and the last ``window`` - 1 returns."""

    def label(key, frames, state):
        import pandas as pd

        last, kept = state.get if state.exists else (None, [])
        kept, out = list(kept), []
        for frame in frames:
            for r in frame.sort_values("ts").itertuples():
                if last:
                    ret = r.close / last - 1
                    kept = [*kept, ret][-window:]
                    total = round(sum(kept), 10)
                    full = len(kept) == window
                    out.append((key[0], r.ts, ret, 2 if full and total > threshold else 0 if full and total < -threshold else 1))
                last = r.close
        state.update((last, kept))
        yield pd.DataFrame(out, columns=["symbol", "ts", "ret", "regime"])

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(label, LABELS, "last double, kept array<double>", "append", "NoTimeout")
