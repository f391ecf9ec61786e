"""Streaming bars and labels against the batch operators."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators.regimes import classify_threshold
from tidemark.streaming.bars import stream_bars, stream_regimes

DAY0 = datetime.datetime(2020, 1, 1)


def run(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_bars(spark, tmp_path):
    rows = [("A", DAY0 + datetime.timedelta(minutes=7 * i), float((i * 37) % 11), 1.0) for i in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double")
    ticks.write.parquet(f"{tmp_path}/t")
    got = run(spark, stream_bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/t")), "bars_out", "complete").orderBy("ts").collect()
    want = ticks.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.min_by("price", "ts"), F.max("price"), F.min("price"), F.max_by("price", "ts"), F.sum("size")).orderBy("ts").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r) for r in want]


def test_regimes(spark, tmp_path):
    closes = [100 * (1 + 0.02 * ((i // 5) % 3 - 1)) ** (i % 5) for i in range(80)]
    rows = [(s, DAY0 + datetime.timedelta(days=i), c) for s in "AB" for i, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    for k in range(2):  # two batches
        bars.where(f"day(ts) % 1 = 0 and datediff(ts, '2020-01-01') {'<' if k == 0 else '>='} 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b")
    got = {(r.symbol, r.ts): r.regime for r in run(spark, stream_regimes(stream, 5, 0.03), "regimes_out").collect()}
    w = [(s, DAY0 + datetime.timedelta(days=i), i - 1, closes[i] / closes[i - 1] - 1) for s in "AB" for i in range(1, 80)]
    want = {(r.symbol, r.ts): r.regime for r in classify_threshold(spark.createDataFrame(w, "symbol string, ts timestamp, ret_index int, ret double"), 5, 0.03).collect()}
    assert got == want and len(set(want.values())) == 3
