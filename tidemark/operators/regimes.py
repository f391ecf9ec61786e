"""Threshold regimes and Markov-chain statistics of regime labels.

Labels are rows (symbol, ts, ret_index, ret, regime), regime 0 bear, 1 sideways,
2 bull; ret_index counts a symbol's returns from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import by_time, whole
from tidemark.functions.indicators import simple_return

NAMES = ("bear", "sideways", "bull")


def returns(bars: DataFrame) -> DataFrame:
    """Simple returns; a symbol's first bar has none."""
    rows = bars.withColumn("ret", simple_return()).withColumn("ret_index", (F.row_number().over(by_time()) - 2).cast("int"))
    return rows.where("ret_index >= 0").select("symbol", "ts", "bar_index", "ret_index", "close", "ret")


def classify_threshold(rets: DataFrame, window: int = 20, threshold: float = 0.05) -> DataFrame:
    """Bull or bear where the sum of the last ``window`` simple returns is above or
    below the threshold, strictly; sideways before and between. The sum is rounded to
    10 digits, so that another order of adding decides alike."""
    last = by_time().rowsBetween(-(window - 1), 0)
    total = F.round(F.sum("ret").over(last), 10)
    full = F.count("ret").over(last) >= window
    return rets.withColumn("regime", F.when(full & (total > threshold), 2).when(full & (total < -threshold), 0).otherwise(1))


def transition_matrix(labels: DataFrame) -> DataFrame:
    """(symbol, from_regime, to_regime, n, p), all nine cells: 1e-10 is added to each
    share of a row, which is then scaled to 1, so an unseen row is uniform."""
    wide = _cells(labels)
    rows = [F.struct(F.lit(i).alias("from_regime"), F.lit(j).alias("to_regime"), F.col(f"c{i}{j}").cast("long").alias("n"), _probability(i, j).alias("p")) for i in range(3) for j in range(3)]
    return wide.select("symbol", F.inline(F.array(*rows)))


def _cells(labels: DataFrame, *more: Column) -> DataFrame:
    """Counts c00 ... c22 of moves per symbol, and ``more`` aggregates, in one grouping."""
    moves = labels.withColumn("__to", F.lead("regime").over(by_time()))
    cells = [F.count_if((F.col("regime") == i) & (F.col("__to") == j)).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    return moves.groupBy("symbol").agg(*cells, *more)


def _probability(i: int, j: int) -> Column:
    n = [F.col(f"c{i}{k}") for k in range(3)]
    share = [F.coalesce(F.try_divide(x, n[0] + n[1] + n[2]), F.lit(0.0)) + 1e-10 for x in n]
    return share[j] / (share[0] + share[1] + share[2])


def matrix_row(transitions: DataFrame) -> DataFrame:
    """One row per symbol with p00 ... p22."""
    return transitions.groupBy("symbol").agg(*[F.max(F.when((F.col("from_regime") == i) & (F.col("to_regime") == j), F.col("p"))).alias(f"p{i}{j}") for i in range(3) for j in range(3)])


def stationary(matrix: DataFrame) -> DataFrame:
    """(symbol, pi_bear, pi_sideways, pi_bull), by the Markov chain tree theorem; the
    smoothed chain is irreducible."""
    return matrix.select("symbol", *_stationary())


def _stationary() -> list[Column]:
    p = lambda i, j: F.col(f"p{i}{j}")
    weight = []
    for r in range(3):
        a, b = (k for k in range(3) if k != r)
        weight.append(p(a, r) * p(b, r) + p(a, b) * p(b, r) + p(b, a) * p(a, r))
    total = weight[0] + weight[1] + weight[2]
    return [(w / total).alias(f"pi_{n}") for w, n in zip(weight, NAMES, strict=True)]


def persistence(matrix: DataFrame) -> DataFrame:
    return matrix.select("symbol", *_persistence())


def _persistence() -> list[Column]:
    return [F.col(f"p{i}{i}").alias(f"stay_{n}") for i, n in enumerate(NAMES)]


def current(labels: DataFrame) -> DataFrame:
    """(symbol, regime, first_date, last_date, n_bear, n_sideways, n_bull)."""
    return labels.groupBy("symbol").agg(*_current())


def _current() -> list[Column]:
    counts = [F.count_if(F.col("regime") == i).alias(f"n_{n}") for i, n in enumerate(NAMES)]
    return [F.max_by("regime", "ret_index").alias("regime"), F.min("ts").alias("first_date"), F.max("ts").alias("last_date"), *counts]


def next_probabilities(matrix: DataFrame, now: DataFrame) -> DataFrame:
    """The current regime's row: (symbol, q0, q1, q2)."""
    pick = lambda j: F.when(F.col("regime") == 0, F.col(f"p0{j}")).when(F.col("regime") == 1, F.col(f"p1{j}")).otherwise(F.col(f"p2{j}"))
    return matrix.join(now.select("symbol", "regime"), "symbol").select("symbol", "regime", *[pick(j).alias(f"q{j}") for j in range(3)], *[f"p{i}{j}" for i in range(3) for j in range(3)])


def signal(nexts: DataFrame) -> DataFrame:
    """P(bull) - P(bear) of the next bar."""
    return nexts.select("symbol", (F.col("q2") - F.col("q0")).alias("signal"))


def forecast(nexts: DataFrame, steps=(1, 5, 20)) -> DataFrame:
    """(symbol, step, f_bear, f_sideways, f_bull): the next bar's row times the matrix
    to the power ``step``, so that step 1 is two bars ahead."""

    def ahead(n: int) -> Column:
        start = F.struct(*[F.col(f"q{j}").alias(f"v{j}") for j in range(3)])
        move = lambda v, _: F.struct(*[(v["v0"] * F.col(f"p0{j}") + v["v1"] * F.col(f"p1{j}") + v["v2"] * F.col(f"p2{j}")).alias(f"v{j}") for j in range(3)])
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, move)

    rows = nexts.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("step"), ahead(n).alias("v")) for n in steps])).alias("f"))
    return rows.select("symbol", "f.step", *[F.col(f"f.v.v{j}").alias(f"f_{n}") for j, n in enumerate(NAMES)])


def markov_stats(labels: DataFrame) -> DataFrame:
    """Counts, dates, current regime, signal, stationary shares and persistence."""
    wide = _cells(labels, *_current())
    wide = wide.withColumns({f"p{i}{j}": _probability(i, j) for i in range(3) for j in range(3)})
    lead = sum((F.when(F.col("regime") == i, F.col(f"p{i}2") - F.col(f"p{i}0")).otherwise(0.0) for i in range(3)), F.lit(0.0))
    now = ["symbol", "regime", "first_date", "last_date", *[f"n_{n}" for n in NAMES]]
    return wide.select(*now, lead.alias("signal"), *_stationary(), *_persistence())


def transitions(labels: DataFrame) -> DataFrame:
    """A row per change of regime, at the bar where the new one begins."""
    rows = labels.withColumn("from_regime", F.lag("regime").over(by_time()))
    return rows.where("regime <> from_regime").select("symbol", "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), "ret_index", "from_regime", F.col("regime").alias("to_regime"))


def latest_transitions(events: DataFrame, k: int) -> DataFrame:
    """The k newest per symbol, newest first; 0 gives all."""
    ranked = events.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    return ranked.where(F.col("rank") <= k) if k else ranked


def _numbered(labels: DataFrame) -> DataFrame:
    """Labels with ``spell``, the number from 0 of a bar's run of its regime."""
    changed = F.coalesce((F.col("regime") != F.lag("regime").over(by_time())).cast("int"), F.lit(0))
    return labels.withColumn("new", changed).withColumn("spell", F.sum("new").over(by_time().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def spells(labels: DataFrame) -> DataFrame:
    """Runs of a regime: (symbol, spell, regime, start_index, end_index, duration,
    censored); the last run of a symbol is censored."""
    runs = _numbered(labels).groupBy("symbol", "spell").agg(F.first("regime").alias("regime"), F.min("ret_index").alias("start_index"), F.max("ret_index").alias("end_index"), F.count("*").alias("duration"))
    return runs.withColumn("censored", F.col("spell") == F.max("spell").over(whole()))


def spell_covariates(labels: DataFrame) -> DataFrame:
    """(symbol, spell, regime, duration, event, volatility, total_log_return): the
    population deviation and the sum of log returns inside each run of a regime."""
    runs = _numbered(labels).groupBy("symbol", "spell").agg(F.first("regime").alias("regime"), F.count("*").alias("duration"), F.stddev_pop(F.log1p("ret")).alias("volatility"), F.sum(F.log1p("ret")).alias("total_log_return"))
    return runs.select("symbol", "spell", "regime", "duration", (F.col("spell") < F.max("spell").over(whole())).alias("event"), "volatility", "total_log_return")
