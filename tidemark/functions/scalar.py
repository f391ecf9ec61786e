"""Column helpers: guarded arithmetic, calendar fields, the gamma function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or the result isn't finite."""
    return null_inf(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b))


def null_inf(x: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def calendar(ts: str = "ts") -> dict[str, Column]:
    day = F.to_date(ts)
    return {
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "is_month_end": (F.last_day(ts) == day).cast("int"),
        "is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
        "is_quarter_end": ((F.last_day(ts) == day) & (F.month(ts) % 3 == 0)).cast("int"),
    }


def cyclical(ts: str = "ts") -> dict[str, Column]:
    turn = lambda x, n: F.lit(2 * math.pi) * x / n
    return {
        "day_of_week_sin": F.sin(turn(F.weekday(ts), 7)),
        "day_of_week_cos": F.cos(turn(F.weekday(ts), 7)),
        "month_sin": F.sin(turn(F.month(ts), 12)),
        "month_cos": F.cos(turn(F.month(ts), 12)),
    }


def intraday(ts: str = "ts") -> dict[str, Column]:
    hour = F.hour(ts)
    turn = F.lit(2 * math.pi) * hour / 24
    return {
        "hour": hour,
        "minute": F.minute(ts),
        "session": F.when(hour < 8, 0).when(hour < 16, 1).otherwise(2),
        "hour_sin": F.sin(turn),
        "hour_cos": F.cos(turn),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


#: Lanczos coefficients for g = 7 (fixed values).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gamma(x: Column) -> Column:
    """The gamma function for x >= 0.5, by Lanczos' series."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, z + 0.5) * F.exp(-t) * series
