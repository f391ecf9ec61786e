"""Bars: from CSV files, from ticks and from the given tables; cleaning and checks.

A bar is (symbol, ts, bar_index, open, high, low, close, volume); every operator
of the library partitions by ``symbol`` and orders by ``ts`` or ``bar_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import by_time
from tidemark.tables import discard, save

OHLCV = ("open", "high", "low", "close", "volume")


#: Names that columns go by, first choices first: a date's name holds one of these,
#: a close's is one of these or else holds one of the second list.
DATES = ("date", "time", "timestamp", "datetime")
NAMES = {"open": ("open",), "high": ("high",), "low": ("low",), "close": ("close", "last", "adj close", "price"), "volume": ("volume", "vol")}
CLOSES = ("close", "adj close", "price", "last")


def _named(names: Column, candidates, within: bool = False) -> Column:
    """Place, from 1, of the first candidate that one of ``names`` is, or holds."""
    at = lambda c: F.array_position(F.transform(names, lambda n: n.contains(c)) if within else names, F.lit(True) if within else c)
    return F.coalesce(*[F.nullif(at(c), F.lit(0).cast("long")) for c in candidates])


def csv_layouts(spark: SparkSession, path: str, date_col: str | None = None, close_col: str | None = None) -> DataFrame:
    """A row per CSV file: its header's ``names`` (lower case) and the place, from 1, of
    the date and of each OHLCV column; null where a file hasn't one.

    The date is the column whose name speaks of one, else the first. Without a name that
    tells of a close, it is the first column but the date that holds numbers alone."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value")
    first = lines.where(F.col("start") == 0).where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    cells = F.split("header", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    names = F.transform(cells, lambda c: F.lower(F.trim(F.regexp_replace(F.trim(c), '^\ufeff?"?|"?$', ""))))
    heads = first.select("file", names.alias("names"))
    given = lambda name, found: F.coalesce(_named(F.col("names"), [name.strip().lower()]), found) if name else found
    heads = heads.withColumn("date", given(date_col, F.coalesce(_named(F.col("names"), DATES, True), F.lit(1).cast("long"))))
    places = {c: _named(F.col("names"), NAMES[c]) for c in OHLCV}
    whole = F.lit(True)
    for place in places.values():
        whole = whole & place.isNotNull()
    # A file with all five columns has its close by exact name, another by what names hold.
    places["close"] = given(close_col, F.coalesce(F.when(whole, places["close"]), _named(F.col("names"), CLOSES, True)))
    heads = heads.withColumns(places)
    unnamed = heads.where("close is null").select("file", "date")
    if unnamed.isEmpty():
        return heads
    cells = _csv_cells(spark, path, heads).join(unnamed, "file")
    place = F.posexplode("cells").alias("k", "cell")
    numbers = cells.select("file", "date", place).where(F.col("k") + 1 != F.col("date")).groupBy("file", "k").agg(F.count("cell").alias("n"), F.count(F.col("cell").try_cast("double")).alias("numbers"))
    # The header's own cell is no number.
    found = numbers.where((F.col("numbers") > 0) & (F.col("numbers") >= F.col("n") - 1)).groupBy("file").agg((F.min("k") + 1).cast("long").alias("numeric"))
    return heads.join(found, "file", "left").withColumn("close", F.coalesce("close", "numeric")).drop("numeric")


def _csv_cells(spark: SparkSession, path: str, heads: DataFrame) -> DataFrame:
    """(file, cells) of all lines of CSV files, as wide as the widest header."""
    width = heads.agg(F.max(F.size("names"))).first()[0] or 1
    columns = [f"c{k}" for k in range(width)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.array(*[F.trim(c) for c in columns]).alias("cells"))


def read_bars_csv(spark: SparkSession, path: str, date_col: str | None = None, close_col: str | None = None) -> DataFrame:
    """Bars of a folder of CSV files, each read by its own header; a file's stem is its
    symbol. Missing OHLCV columns are null, and so is what is no number; rows without a
    time or close are dropped, header lines among them. A file in which no column can
    be a close is an error."""
    heads = csv_layouts(spark, path, date_col, close_col)
    lost = [r.file for r in heads.where("close is null").select("file").limit(5).collect()]
    if lost:
        raise ValueError(f"no column can be a close in {', '.join(lost)}")
    rows = _csv_cells(spark, path, heads).join(heads.drop("names"), "file")
    cell = lambda c: F.element_at("cells", F.col(c).cast("int"))
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"\.csv(\.gz)?$", "")
    return clean_bars(rows.select(stem.alias("symbol"), cell("date").try_cast("timestamp").alias("ts"), *[cell(c).try_cast("double").alias(c) for c in OHLCV]))


def clean_bars(bars: DataFrame) -> DataFrame:
    """Drop rows without a time or close, keep one row per symbol and time (the
    smallest, as rows have no order), and number the bars."""
    rows = bars.where("ts is not null and close is not null and not isnan(close)")
    one = rows.groupBy("symbol", "ts").agg(F.min(F.struct(*OHLCV)).alias("bar")).select("symbol", "ts", "bar.*")
    return one.withColumn("bar_index", (F.row_number().over(by_time()) - 1).cast("int"))


def validate_bars(bars: DataFrame, min_rows: int = 2) -> DataFrame:
    """(symbol, problem): too few rows, missing columns' values, high below low."""
    facts = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.count("close").alias("n_close"), *[F.count(c).alias(f"has_{c}") for c in OHLCV], F.count_if(F.col("high") < F.col("low")).alias("crossed"))
    tests = [(F.col("n") < min_rows, f"fewer than {min_rows} rows"), (F.col("n_close") < F.col("n"), "close is missing"), (F.least(*[F.col(f"has_{c}") for c in OHLCV]) == 0, "an OHLCV column is empty"), (F.col("crossed") > 0, "high below low")]
    return facts.select("symbol", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests]))).alias("problem"))


def ticks_to_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, size: Column, every: str = "hour") -> DataFrame:
    """OHLCV bars per symbol and ``every`` (a unit of ``date_trunc``); the first and
    last price are by time, ties by price."""
    t = ticks.select(symbol.alias("symbol"), ts.alias("at"), F.date_trunc(every, ts).alias("ts"), price.alias("p"), size.alias("v"))
    order = F.struct("at", "p")
    bars = t.groupBy("symbol", "ts").agg(F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.sum("v").cast("double").alias("volume"))
    return bars.withColumn("bar_index", (F.row_number().over(by_time()) - 1).cast("int"))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events' positive values, a symbol per event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    return ticks_to_bars(events, F.col("event_type"), F.col("ts").cast("timestamp"), F.col("value"), F.lit(1))


def index_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily price index per l_returnflag and l_linestatus, from its revenue.

    A day's revenue in whole ten-thousandths, standardised over the symbol and
    scaled to 2 % a day, is the log return; highs and lows stand off by the spread
    of unit prices. Returns and prices are rounded, so that another engine's sums
    give the same bars.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    cents = F.round(price.cast("double") * 100).cast("long") * F.round((1 - off.cast("double")) * 100).cast("long")
    unit = price.cast("double") / F.col("l_quantity").cast("double")
    days = lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts")).agg(
        F.sum(cents).alias("v"), F.max(unit).alias("hi"), F.min(unit).alias("lo"), F.sum(F.col("l_quantity").cast("double")).alias("volume")
    )
    group = Window.partitionBy("symbol")
    x = F.round(0.02 * (F.col("v") - F.avg("v").over(group)) / F.stddev_samp("v").over(group), 8)
    level = F.sum(F.coalesce(F.col("x"), F.lit(0.0)).cast("decimal(18,8)")).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("x", x).withColumn("close", F.round(100 * F.exp(level.cast("double")), 6))
    days = days.withColumn("open", F.coalesce(F.lag("close").over(by_time()), F.lit(100.0))).withColumn("g", 0.01 * (F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo")))
    return days.select(
        "symbol", "ts", (F.row_number().over(by_time()) - 1).cast("int").alias("bar_index"), "open",
        F.round(F.greatest("open", "close") * (1 + F.col("g")), 6).alias("high"), F.round(F.least("open", "close") * (1 - F.col("g")), 6).alias("low"), "close", "volume",
    )


#: The same panel for the checks in SQL, as the CTE ``bars``.
BARS_SQL = """days AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts,
         sum(CAST(round(CAST(l_extendedprice AS DOUBLE) * 100) AS BIGINT) * CAST(round((1 - CAST(l_discount AS DOUBLE)) * 100) AS BIGINT)) AS v,
         max(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS hi, min(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS lo,
         sum(CAST(l_quantity AS DOUBLE)) AS volume
  FROM lineitem GROUP BY 1, 2),
scaled AS (SELECT *, round(0.02 * (v - avg(v) OVER (PARTITION BY symbol)) / stddev_samp(v) OVER (PARTITION BY symbol), 8) AS x FROM days),
closed AS (SELECT *, round(100 * exp(CAST(sum(CAST(coalesce(x, 0) AS DECIMAL(18, 8))) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE)), 6) AS close FROM scaled),
opened AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 100.0) AS open, 0.01 * (hi - lo) / (hi + lo) AS g FROM closed),
bars AS (
  SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INTEGER) AS bar_index, CAST(open AS DOUBLE) AS open,
         round(greatest(open, close) * (1 + g), 6) AS high, round(least(open, close) * (1 - g), 6) AS low, close, volume FROM opened)"""


def write_results_json(results: DataFrame, path: str) -> None:
    """One JSON record per row; nulls stay out of no record."""
    results.write.option("ignoreNullFields", False).json(path)


def write_saliency(saliency: DataFrame, path: str, threshold: float = 0.5) -> None:
    """feature, weight and whether it is selected, as CSV."""
    saliency.select("feature", F.col("rho").alias("saliency_weight"), F.when(F.col("rho") >= threshold, "yes").otherwise("no").alias("selected")).write.option("header", True).csv(path)


def skip_done(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a grid of runs that aren't among the results yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(results: DataFrame, path: str, keys: list[str] | None = None) -> int | None:
    """Without ``keys``, a plain append. Else add to the Parquet table at ``path``
    those of ``results`` whose ``keys`` it doesn't hold yet, and return how many that
    were. So a run that is repeated, whole or in
    part, adds nothing twice; of repeated keys in ``results`` one row is added.

    Rows go to a folder whose name is made of their keys: two runs at once that add the
    same rows write the same folder, and readers take one row per key (``read_results``)."""
    if keys is None:
        return results.write.mode("append").parquet(path)
    spark = results.sparkSession
    fresh = results.dropDuplicates(keys)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(files):
        fresh = fresh.join(spark.read.option("recursiveFileLookup", True).parquet(path).select(*keys).distinct(), keys, "left_anti")
    fresh = save(fresh, "fresh-results")
    n, mark = fresh.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*keys).cast("decimal(20, 0)")), F.lit(0))).first()
    if n:
        fresh.write.mode("overwrite").parquet(f"{path}/commit-{n}-{mark}")
    discard(fresh)
    return n


def read_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that ``append_results`` has made, one row per key."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).dropDuplicates(keys)
