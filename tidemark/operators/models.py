"""Stored models: Gaussian states by (symbol, refit), and scores of any bars by them.

A model is a row (symbol, refit, n, columns, center, scale, states), a state being
(state, start, mean, variance, to): its start probability, means and variances of the
scaled features, and its transition probabilities. It knows nothing of bars from
``refit`` on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least variance of a scaled feature, and what a scale gets added.
FLOOR, TINY = 1e-6, 1e-8
STATE = "struct<state: int, start: double, mean: array<double>, variance: array<double>, to: array<double>>"


def models_of_labels(labels: DataFrame, features: DataFrame, columns: list[str], refits: DataFrame, n_states: int = 3) -> DataFrame:
    """Models read off ``labels(symbol, ret_index, regime)``: for each of ``refits(symbol,
    refit)`` the states are the regimes of the bars before it whose ``features`` are all
    known. Shares, moments and moves are running sums by symbol up to a refit, so each
    bar is read once however many refits there are; a state without bars has mean 0,
    variance 1 and start 0. Moves get one bar more for each pair of states."""
    given = features.select("symbol", "ret_index", *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    rows = labels.select("symbol", "ret_index", "regime").join(given, ["symbol", "ret_index"])
    past = Window.partitionBy("symbol").orderBy("ret_index").rowsBetween(Window.unboundedPreceding, -1)
    by_time = Window.partitionBy("symbol").orderBy("ret_index")
    rows = rows.withColumn("moved", F.struct(F.lag("regime").over(by_time).alias("i"), F.col("regime").alias("j")))
    own = lambda k, c: F.when(F.col("regime") == k, c)
    sums = {"n": F.count("*").over(past)}
    for k in range(n_states):
        sums[f"n_{k}"] = F.count(own(k, F.lit(1))).over(past)
        for d, c in enumerate(columns):
            sums |= {f"x_{k}_{d}": F.coalesce(F.sum(own(k, F.col(c))).over(past), F.lit(0.0)), f"xx_{k}_{d}": F.coalesce(F.sum(own(k, F.col(c) * F.col(c))).over(past), F.lit(0.0))}
        for j in range(n_states):
            sums[f"m_{k}_{j}"] = F.count(F.when((F.col("moved.i") == k) & (F.col("moved.j") == j), 1)).over(past)
    at = rows.select("symbol", F.col("ret_index").alias("refit"), *[c.alias(name) for name, c in sums.items()]).join(refits.select("symbol", "refit"), ["symbol", "refit"]).where("n > 0")
    each = range(len(columns))
    total = lambda kind, d: sum((F.col(f"{kind}_{k}_{d}") for k in range(n_states)), F.lit(0.0))
    center = [total("x", d) / F.col("n") for d in each]
    spread = [F.sqrt(F.greatest(total("xx", d) / F.col("n") - center[d] * center[d], F.lit(0.0))) + TINY for d in each]
    at = at.withColumns({"center": F.array(*center), "scale": F.array(*spread)})

    def state(k: int) -> Column:
        n = F.col(f"n_{k}")
        mean = [F.coalesce(F.try_divide(F.col(f"x_{k}_{d}"), n), F.get("center", F.lit(d))) for d in each]
        second = [F.try_divide(F.col(f"xx_{k}_{d}"), n) - mean[d] * mean[d] for d in each]
        scale = lambda d: F.get("scale", F.lit(d))
        scaled = F.array(*[(mean[d] - F.get("center", F.lit(d))) / scale(d) for d in each])
        variance = F.array(*[F.when(n > 0, F.greatest(second[d] / (scale(d) * scale(d)), F.lit(FLOOR))).otherwise(1.0) for d in each])
        left = sum((F.col(f"m_{k}_{j}") for j in range(n_states)), F.lit(0))
        return F.struct(F.lit(k).alias("state"), (n / F.col("n")).alias("start"), scaled.alias("mean"), variance.alias("variance"), F.array(*[(F.col(f"m_{k}_{j}") + 1) / (left + n_states) for j in range(n_states)]).alias("to"))

    return at.select("symbol", "refit", F.col("n").cast("int"), F.array(*map(F.lit, columns)).alias("columns"), "center", "scale", F.array(*[state(k) for k in range(n_states)]).cast(f"array<{STATE}>").alias("states"))


def looked_up(bars: DataFrame, models: DataFrame, ahead: int = 0) -> DataFrame:
    """``bars(symbol, ret_index, ...)`` with the ``refit`` of the latest model at or before
    each, or up to ``ahead`` bars after it: with 1 a slice's last bar gets the model that
    was made of it. Bars before the first model are left out. Only refits' numbers are
    carried over the bars; the models are joined by equality."""
    marks = models.select("symbol", (F.col("refit") - ahead).alias("ret_index"), F.col("refit").alias("known"))
    rows = bars.select("symbol", "ret_index", F.struct(*bars.columns).alias("bar")).join(marks, ["symbol", "ret_index"], "full")
    upto = Window.partitionBy("symbol").orderBy("ret_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("refit", F.last("known", ignorenulls=True).over(upto)).where("bar is not null and refit is not null").select("bar.*", "refit")


def log_density(z: Column, state: Column) -> Column:
    """Log density of scaled features under a state's independent normals."""
    terms = F.zip_with(F.zip_with(z, state["mean"], lambda x, m: (x - m) * (x - m)), state["variance"], lambda d, v: F.ln(v * (2 * math.pi)) + d / v)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) * -0.5


def _softmax(logs: Column) -> Column:
    """Of an array column in ``logs``; a column of its own holds it, so it is worked out once."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def _scaled(bars: DataFrame, models: DataFrame, columns: list[str], ahead: int) -> DataFrame:
    rows = looked_up(bars.dropna(subset=columns), models, ahead).join(models.select("symbol", "refit", "center", "scale", "states"), ["symbol", "refit"])
    z = F.array(*[(F.col(c).cast("double") - F.get("center", F.lit(d))) / F.get("scale", F.lit(d)) for d, c in enumerate(columns)])
    return rows.withColumn("z", z).withColumn("logs", F.transform("states", lambda s: log_density(F.col("z"), s)))


def score_bars(bars: DataFrame, models: DataFrame, columns: list[str], ahead: int = 0) -> DataFrame:
    """(symbol, ret_index, refit, posterior): states' probabilities of each of ``bars(symbol,
    ret_index, *columns)`` under its model, by start probability and its own density. Bars
    with unknown features are left out; a density too small for a number counts as is,
    in logarithms."""
    rows = _scaled(bars, models, columns, ahead)
    prior = F.zip_with("logs", F.transform("states", lambda s: F.ln(s["start"] + 1e-300)), lambda a, b: a + b)
    return rows.withColumn("logs", prior).select("symbol", "ret_index", "refit", _softmax(F.col("logs")).alias("posterior"))


def filter_bars(bars: DataFrame, models: DataFrame, columns: list[str], ahead: int = 0) -> DataFrame:
    """Like ``score_bars``, but given all of a model's bars so far: the scaled forward
    recursion from the start probabilities over the bars that one model scores. These
    are a group of their own, as long as refits lie apart."""
    rows = _scaled(bars, models, columns, ahead)
    runs = rows.groupBy("symbol", "refit").agg(F.sort_array(F.collect_list(F.struct("ret_index", "logs"))).alias("run"), F.first("states").alias("states"))
    n = F.size("states")
    first = F.transform("states", lambda s: s["start"])

    def step(acc, bar):
        ahead = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.aggregate(F.zip_with(acc["p"], F.transform("states", lambda s: F.get(s["to"], j)), lambda a, t: a * t), F.lit(0.0), lambda s, x: s + x))
        prior = F.when(F.size(acc["out"]) == 0, first).otherwise(ahead)
        logs = F.zip_with(prior, bar["logs"], lambda a, b: F.ln(a + 1e-300) + b)
        p = F.transform(F.array(logs), _softmax)[0]
        return F.transform(F.array(p), lambda p: F.struct(p.alias("p"), F.concat(acc["out"], F.array(F.struct(bar["ret_index"].alias("ret_index"), p.alias("posterior")))).alias("out")))[0]

    start = F.struct(first.alias("p"), F.array().cast("array<struct<ret_index: int, posterior: array<double>>>").alias("out"))
    out = runs.withColumn("out", F.aggregate("run", start, step, lambda acc: acc["out"]))
    return out.select("symbol", "refit", F.explode("out").alias("o")).select("symbol", "o.ret_index", "refit", "o.posterior")
