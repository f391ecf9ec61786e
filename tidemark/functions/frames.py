"""The window that all bar-wise operators share: a symbol's rows by time."""

from __future__ import annotations

from pyspark.sql import Window


def by_time():
    return Window.partitionBy("symbol").orderBy("ts")


def running():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return Window.partitionBy("symbol")
