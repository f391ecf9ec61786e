"""Grids of configurations, their evaluation, and comparisons of the results.

A result row is (symbol, config_id, parameter columns ..., sharpe, max_drawdown,
n_trades, win_rate, profit_factor, total_return, is_default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest

METRICS = ("sharpe", "total_return", "win_rate", "profit_factor", "max_drawdown")
#: Weights of the composite score.
WEIGHTS = {"sharpe": 0.30, "total_return": 0.25, "max_drawdown": 0.20, "win_rate": 0.15, "profit_factor": 0.10}


def factorial_grid(spark: SparkSession, parameters: dict[str, list], default: dict) -> DataFrame:
    """Every combination of the parameters, numbered; a few rows by construction."""
    grid = spark.range(1).drop("id")
    for name, values in parameters.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    same = F.lit(True)
    for name, value in default.items():
        same = same & (F.col(name) == F.lit(value))
    order = Window.orderBy(*parameters)
    return grid.withColumn("config_id", F.row_number().over(order).cast("int")).withColumn("is_default", same)


def one_at_a_time(spark: SparkSession, parameters: dict[str, list], default: dict) -> DataFrame:
    """The default, and each parameter moved alone."""
    grid = factorial_grid(spark, parameters, default)
    moved = sum((F.when(F.col(k) == F.lit(v), 0).otherwise(1) for k, v in default.items()), F.lit(0))
    return grid.where(moved <= 1)


def sweep_threshold(rets: DataFrame, grid: DataFrame, min_train: int = 252) -> DataFrame:
    """Results of threshold regimes for each symbol and (window, threshold) of the
    grid. Returns are summed once per window, not per configuration; the grid is a
    small table of parameters."""
    order = Window.partitionBy("symbol").orderBy("ts")
    widths = [r.window for r in grid.select("window").distinct().collect()]
    sums = {}
    for n in widths:
        last = order.rowsBetween(-(n - 1), 0)
        sums[n] = F.when(F.count("ret").over(last) >= n, F.round(F.sum("ret").over(last), 10))
    wide = rets.select("symbol", "ts", "ret_index", "ret", F.create_map(*[x for n in widths for x in (F.lit(n), sums[n])]).alias("sums"))
    rows = wide.crossJoin(F.broadcast(grid))
    total = F.col("sums")[F.col("window")]
    rows = rows.withColumn("regime", F.when(total > F.col("threshold"), 2).when(total < -F.col("threshold"), 0).otherwise(1)).drop("sums")
    keys = ("symbol", "config_id")
    rows = rows.repartition(*keys)
    found = backtest.metrics(backtest.equity(backtest.positions(rows, min_train), min_train, keys), keys)
    return found.join(F.broadcast(grid), "config_id").drop("n_equity")


#: Labels that a share among the last ones is taken over, where an engine has no posterior.
SHARE_BARS = 20


def sweep_filters(rets: DataFrame, grid: DataFrame, min_train: int = 252) -> DataFrame:
    """Results of threshold regimes for each symbol and (window, threshold, dwell, lead) of
    the grid. Bars are labelled once per (window, threshold) and dealt out by symbol and
    label; what is dealt doesn't grow with the filters. These are folded side by side,
    and a bar is only taken apart into its filters' positions where it lies. The
    posterior that a lead is measured on is a regime's share of the last 20 labels."""
    rows = grid.select("window", "threshold", "dwell", "lead", "config_id").collect()
    filters = sorted({(r.dwell, r.lead) for r in rows})
    kinds = sorted({(r.window, r.threshold) for r in rows})
    order = Window.partitionBy("symbol").orderBy("ts")
    sums = {n: F.round(F.sum("ret").over(order.rowsBetween(-(n - 1), 0)), 10) for n in {w for w, _ in kinds}}
    full = lambda n: F.count("ret").over(order.rowsBetween(-(n - 1), 0)) >= n
    wide = rets.select("symbol", "ts", "ret_index", "ret", *[F.when(full(n), c).alias(f"sum_{n}") for n, c in sums.items()])
    regime = lambda n, t: F.when(F.col(f"sum_{n}") > t, 2).when(F.col(f"sum_{n}") < -t, 0).otherwise(1)
    wide = wide.withColumns({f"regime_{k}": regime(n, t) for k, (n, t) in enumerate(kinds)})
    last = order.rowsBetween(-(SHARE_BARS - 1), 0)
    share = lambda k: F.array(*[F.count_if(F.col(f"regime_{k}") == r).over(last) / SHARE_BARS for r in range(3)])
    wide = wide.withColumns({f"share_{k}": share(k) for k in range(len(kinds))})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"regime_{k}").alias("regime"), F.col(f"share_{k}").alias("posterior")) for k in range(len(kinds))]))
    labels = wide.select("symbol", "ts", "ret_index", "ret", each.alias("l")).select("symbol", "ts", "ret_index", "ret", "l.*")
    by_label = ("symbol", "label")
    held = backtest.filtered_many(labels, filters, min_train, by_label).drop("posterior").repartition(*by_label)
    keys = (*by_label, "filter")
    apart = held.select("symbol", "label", "ts", "ret_index", "ret", F.posexplode("positions").alias("filter", "position"))
    found = backtest.metrics(backtest.equity(apart, min_train, keys), keys)
    place = {(*kinds[k], *filters[f]): (k, f) for k in range(len(kinds)) for f in range(len(filters))}
    spark = rets.sparkSession
    named = spark.createDataFrame([(r.config_id, *place[r.window, r.threshold, r.dwell, r.lead]) for r in rows], "config_id int, label int, filter int")
    return found.join(F.broadcast(named), ["label", "filter"]).join(F.broadcast(grid), "config_id").drop("label", "filter", "n_equity")


def evaluate(engines: dict[str, DataFrame], min_train: int = 252, filters: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """Symbols x engines in one table: current regime, counts of regimes and the
    metrics of each engine's ``labels(symbol, ts, ret_index, ret, regime)``, its
    positions under the engine's filter of ``filters`` (bars to dwell, least lead of the
    posterior). The engines' rows are put under each other and measured in one pass."""
    rows, keys = None, ("symbol", "engine")
    for name, labels in engines.items():
        dwell, lead = (filters or {}).get(name, (0, 0.0))
        columns = ["symbol", "ts", "ret_index", "ret", "regime", *(["posterior"] if "posterior" in labels.columns else [])]
        one = backtest.filtered_positions(labels.select(*columns), min_train, dwell, lead)
        one = one.select("symbol", F.lit(name).alias("engine"), "ts", "ret_index", "ret", "regime", "position")
        rows = one if rows is None else rows.unionByName(one)
    counts = [F.count_if(F.col("regime") == k).alias(f"n_{n}") for k, n in enumerate(("bear", "sideways", "bull"))]
    now = rows.groupBy(*keys).agg(F.max_by("regime", "ret_index").alias("regime"), *counts)
    return now.join(backtest.metrics(backtest.equity(rows, min_train, keys), keys), list(keys))


def filter_valid(results: DataFrame) -> DataFrame:
    error = F.col("error").isNull() if "error" in results.columns else F.lit(True)
    return results.where(error & F.col("sharpe").isNotNull())


def best_config(results: DataFrame, metric: str) -> DataFrame:
    """(symbol, metric, config_id, value): the largest of a symbol (of the drawdown,
    the one closest to zero), the lowest number at ties."""
    ranked = results.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(metric), "config_id")))
    return ranked.where("rank = 1").select("symbol", F.lit(metric).alias("metric"), "config_id", F.col(metric).alias("value"))


def best_configs(results: DataFrame) -> DataFrame:
    out = best_config(results, METRICS[0])
    for metric in METRICS[1:]:
        out = out.unionByName(best_config(results, metric))
    return out


def extremes(results: DataFrame, metric: str = "sharpe", k: int = 10) -> DataFrame:
    """The k best and k worst results of all."""
    rows = results.where(F.col(metric).isNotNull())
    top = rows.orderBy(F.desc(metric), "symbol", "config_id").limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(rows.orderBy(F.asc(metric), "symbol", "config_id").limit(k).withColumn("side", F.lit("bottom"))).select("side", "symbol", "config_id", metric)


def composite_score(results: DataFrame) -> DataFrame:
    """(symbol, config_id, score): weighted z-scores over the symbol's results; a
    metric that doesn't vary or is null counts 0."""
    whole = Window.partitionBy("symbol")
    score = F.lit(0.0)
    for metric, weight in WEIGHTS.items():
        score = score + weight * F.coalesce(F.try_divide(F.col(metric) - F.avg(metric).over(whole), F.stddev_samp(metric).over(whole)), F.lit(0.0))
    return results.select("symbol", "config_id", score.alias("score"))


def win_counts(results: DataFrame, parameter: str, metric: str = "sharpe") -> DataFrame:
    """How often each value of a parameter is in a symbol's best result."""
    best = best_config(results, metric).join(results.select("symbol", "config_id", parameter), ["symbol", "config_id"])
    return best.groupBy(parameter).agg(F.count("*").alias("wins"))


def top_frequency(results: DataFrame, parameters: list[str], k: int = 3, metric: str = "sharpe") -> DataFrame:
    """(parameter, value, n) among each symbol's top k."""
    ranked = results.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(metric), "config_id")))
    return _long(ranked.where(F.col("rank") <= k), parameters).groupBy("parameter", "value").agg(F.count("*").alias("n"))


def _long(rows: DataFrame, parameters: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in parameters])
    return rows.withColumn("pair", F.explode(pairs)).select("*", "pair.*").drop("pair")


def rank_configs(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Mean, upper median, and share above 0.1 of a metric per configuration."""
    of = Window.partitionBy("config_id")
    d = results.where(F.col(metric).isNotNull()).select("config_id", F.col(metric).alias("x"))
    d = d.withColumns({"rank": F.row_number().over(of.orderBy("x")) - 1, "size": F.count("*").over(of)})
    return d.groupBy("config_id").agg(F.avg("x").alias("mean"), F.max(F.when(F.col("rank") == F.floor(F.col("size") / 2), F.col("x"))).alias("median"), F.avg((F.col("x") > 0.1).cast("double")).alias("positive_share"), F.count("*").alias("n"))


def parameter_impact(results: DataFrame, parameters: list[str], metric: str = "sharpe") -> DataFrame:
    rows = _long(results.where(F.col(metric).isNotNull()), parameters)
    return rows.groupBy("parameter", "value").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("deviation"), F.min(metric).alias("least"), F.max(metric).alias("most"), F.count("*").alias("n"))


def versus_default(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """(symbol, config_id, value, base, lift) against the symbol's default."""
    base = F.max(F.when(F.col("is_default"), F.col(metric))).over(Window.partitionBy("symbol"))
    return results.select("symbol", "config_id", F.col(metric).alias("value"), base.alias("base")).withColumn("lift", F.col("value") - F.col("base"))


def improved_counts(lifts: DataFrame, by: float = 0.01) -> DataFrame:
    known = lifts.where("lift is not null")
    return known.groupBy("config_id").agg(F.count_if(F.col("lift") > by).alias("improved"), F.count_if(F.col("lift") < -by).alias("worsened"), F.count_if(F.abs("lift") <= by).alias("neutral"))


def default_vs_best(results: DataFrame) -> DataFrame:
    """(metric, mean_default, mean_best, lift) over symbols."""
    best = best_configs(results)
    out = None
    for metric in METRICS:
        base = results.where("is_default").select("symbol", F.col(metric).alias("base"))
        row = best.where(F.col("metric") == metric).join(base, "symbol").agg(F.lit(metric).alias("metric"), F.avg("base").alias("mean_default"), F.avg("value").alias("mean_best"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("lift", F.col("mean_best") - F.col("mean_default"))


def engine_agreement(labels: DataFrame) -> DataFrame:
    """(symbol, engines, agree): whether all engines' last labels are equal, from
    ``labels(symbol, engine, ret_index, regime)`` with two engines or more."""
    last = labels.groupBy("symbol", "engine").agg(F.max_by("regime", "ret_index").alias("regime"))
    return last.groupBy("symbol").agg(F.count("*").alias("engines"), F.count_distinct("regime").alias("kinds")).where("engines >= 2").select("symbol", "engines", (F.col("kinds") == 1).alias("agree"))


def runtime_summary(runs: DataFrame) -> DataFrame:
    """Mean, median and extremes of ``runs(engine, seconds)``."""
    return runs.groupBy("engine").agg(F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))


def saliency_summary(saliency: DataFrame, threshold: float = 0.5) -> DataFrame:
    return saliency.groupBy("symbol").agg(F.avg("rho").alias("mean"), F.median("rho").alias("median"), F.max("rho").alias("most"), F.count_if(F.col("rho") >= threshold).alias("selected"))


#: A feature's category is the first of which its name, in lower case,
#: has one of the parts.
CATEGORIES = (
    ("Returns", ("log_ret", "simple_ret")),
    ("Moving Averages", ("ma_", "sma_", "ema_", "tma_", "wma_", "hma_")),
    ("Volatility", ("atr", "volatility", "bb_", "kc_", "keltner_", "donchian_", "chaikin_vol", "hv_")),
    ("Momentum", ("rsi", "roc", "macd", "stoch", "williams", "cci", "mfi", "mtm_", "proc")),
    ("Volume", ("volume_", "obv", "vwap", "adl", "vpt", "eom_")),
    ("Trend", ("adx", "aroon", "di_", "dpo")),
    ("Price Patterns", ("price_position", "hl_ratio")),
    ("Time-based", ("day_of", "month", "quarter", "hour", "minute", "session", "is_", "_sin", "_cos")),
)


def feature_category(feature: str = "feature"):
    name = F.lower(feature)
    found = [F.when(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(name, p)), category) for category, parts in CATEGORIES]
    return F.coalesce(*found, F.lit("Other"))


def saliency_audit(saliency: DataFrame) -> DataFrame:
    """Per feature over seeds and symbols: mean, population deviation, extremes, rank."""
    d = saliency.groupBy("feature").agg(F.avg("rho").alias("mean"), F.stddev_pop("rho").alias("deviation"), F.min("rho").alias("least"), F.max("rho").alias("most"), F.count("*").alias("n"))
    return d.withColumn("category", feature_category()).withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))))


def category_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("category").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("deviation"), F.count("*").alias("n"))
