"""Flags on fits, the verdict, records and checks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.regimes import NAMES
from tidemark.operators.survival import expected_total


def shares(counts: DataFrame) -> DataFrame:
    total = F.col("n_bear") + F.col("n_sideways") + F.col("n_bull")
    return counts.withColumns({f"share_{n}": F.try_divide(f"n_{n}", total) for n in NAMES} | {"n_bars": total})


def collapse_flag(counts: DataFrame, n_states: int = 3, floor: float = 0.05) -> DataFrame:
    """Whether a reachable regime has less than ``floor`` of the bars, and which. With
    one state only sideways can be reached, with two only bear and bull."""
    reachable = {1: ("sideways",), 2: ("bear", "bull")}.get(n_states, NAMES)
    low = F.array_compact(F.array(*[F.when(F.col(f"share_{n}") < floor, F.lit(n)) for n in reachable]))
    d = shares(counts).withColumn("collapsed", low)
    caveat = F.when(F.size("collapsed") > 0, F.concat(F.lit("few bars in: "), F.array_join("collapsed", ", ")))
    return d.withColumns({"degenerate": F.size("collapsed") > 0, "caveat": caveat}).drop("collapsed")


def low_data_flag(counts: DataFrame, n_features: int, n_states: int) -> DataFrame:
    """Fewer than four bars per feature and state."""
    return shares(counts).withColumn("low_data", F.col("n_bars") < 4 * n_features * n_states)


def over_robust_flag(robust: DataFrame, plain: DataFrame, within: float = 0.1) -> DataFrame:
    """Whether a robust engine's regime shares are all close to the plain engine's."""
    r = shares(robust).select("symbol", *[f"share_{n}" for n in NAMES])
    p = shares(plain).select("symbol", *[F.col(f"share_{n}").alias(f"plain_{n}") for n in NAMES])
    close = [F.abs(F.col(f"share_{n}") - F.col(f"plain_{n}")) < within for n in NAMES]
    return r.join(p, "symbol").withColumn("over_robust", close[0] & close[1] & close[2])


def dynamic_threshold(base: float = 0.1) -> Column:
    """The sideways threshold: ``base`` until a regime is older than its expected life,
    then times 2 - age / life, at least 0.3."""
    aging = F.try_divide(F.col("days_in_regime"), expected_total())
    return F.when(aging > 1, base * F.greatest(F.lit(0.3), 2 - aging)).otherwise(F.lit(base))


def verdict(stats: DataFrame) -> DataFrame:
    """Add verdict and confidence from regime, signal, ``threshold`` and the 20-step
    forecast (f_bear, f_bull). Bull and bear regimes stand if the forecast has them
    ahead, else they are in transition; sideways is neutral below the threshold."""
    leads = F.col("f_bull") > F.col("f_bear")
    trails = F.col("f_bear") > F.col("f_bull")
    said = (
        F.when(F.col("regime") == 2, F.when(leads, "bullish").otherwise("transition_bear"))
        .when(F.col("regime") == 0, F.when(trails, "bearish").otherwise("transition_bull"))
        .when(F.abs("signal") < F.col("threshold"), "neutral")
        .otherwise(F.when(F.col("signal") > 0, "transition_bull").otherwise("transition_bear"))
    )
    return stats.withColumns({"verdict": said, "confidence": F.round(F.abs("signal"), 4)})


def assemble(stats: DataFrame, metrics: DataFrame, forecasts: DataFrame, engine: str) -> DataFrame:
    """One nested record per symbol."""
    steps = forecasts.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat("step", F.lit("_step")), F.struct(*[f"f_{n}" for n in NAMES]))))).alias("forecast"))
    d = stats.join(metrics, "symbol", "left").join(steps, "symbol", "left")
    return d.select(
        F.col("symbol").alias("source"), F.lit(engine).alias("engine"), F.struct(F.date_format("first_date", "yyyy-MM-dd").alias("start"), F.date_format("last_date", "yyyy-MM-dd").alias("end")).alias("dates"),
        F.struct(F.element_at(F.array(*map(F.lit, NAMES)), F.col("regime") + 1).alias("name"), F.col("regime").alias("index")).alias("current_regime"), "signal",
        F.struct(*[f"pi_{n}" for n in NAMES]).alias("stationary_distribution"), F.struct(*[f"stay_{n}" for n in NAMES]).alias("persistence_diagonal"), F.struct(*[f"n_{n}" for n in NAMES]).alias("regime_counts"),
        F.struct("sharpe", "max_drawdown", "n_trades", "win_rate", "profit_factor", "total_return").alias("walk_forward"), "forecast",
    )


def validate_results(results: DataFrame) -> DataFrame:
    """(symbol, problem) rows for results that can't be trusted: an empty or dominant
    regime, no trades, a signal or persistence out of range."""
    total = F.col("n_bear") + F.col("n_sideways") + F.col("n_bull")
    share = lambda n: F.try_divide(f"n_{n}", total)
    tests = [(F.col(f"n_{n}") == 0, f"empty regime: {n}") for n in NAMES] + [(share(n) > 0.95, f"dominant regime: {n}") for n in NAMES]
    tests += [(F.col("n_trades") == 0, "no trades"), (F.abs("signal") > 1, "signal out of range"), (~F.col("regime").isin(0, 1, 2), "unknown regime")]
    tests += [(~F.col(f"stay_{n}").between(0, 1), f"persistence out of range: {n}") for n in NAMES]
    tests += [(F.abs(F.col("pi_bear") + F.col("pi_sideways") + F.col("pi_bull") - 1) > 1e-6, "shares don't add to 1")]
    return results.select("symbol", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests]))).alias("problem"))
