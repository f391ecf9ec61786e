"""One symbol over many tasks: ranges, filters by blocks, fits by counted durations."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import DAY0, column, labels
from tidemark.functions.frames import by_time
from tidemark.operators import backtest as bt
from tidemark.operators import evaluation as ev
from tidemark.operators import features as feat
from tidemark.operators import ranges as rng
from tidemark.operators import regimes as rg
from tidemark.operators import survival as sv
from tidemark.sources import bars as src

SF = "/root/testdata/sf0.001"


def close_to(got, want, keys, digits=1e-9):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    order = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(map(repr, (r[k] for k in keys))))
    a, b = order(got), order(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for c in names:
            if isinstance(y[c], float) and x[c] is not None:
                assert math.isclose(x[c], y[c], rel_tol=digits, abs_tol=1e-7), (c, x[c], y[c])
            else:
                assert x[c] == y[c], (c, x[c], y[c])


@pytest.fixture(scope="module")
def panel(spark):
    return src.index_panel(spark, SF).where("symbol in ('AF', 'RF')").cache()


def test_bars_are_numbered_in_slots(spark, panel):
    got = rng.numbered(panel.drop("bar_index"), rows=50)
    assert got.count() == panel.count() and got.exceptAll(panel.select(got.columns)).isEmpty()


def test_generic_features_of_ranges(panel):
    close_to(rng.generic(panel, rows=450, halo=440), feat.generic(panel), ("symbol", "bar_index"))


def test_a_hot_symbol_uses_many_tasks(spark, panel):
    one = panel.where("symbol = 'AF'")
    mean = F.avg("close").over(by_time().rowsBetween(-9, 0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = rng.in_ranges(one, lambda d: d.withColumn("mean", mean).withColumn("task", F.spark_partition_id()), rows=100, halo=10)
        tasks = made.groupBy("task").agg(F.count("mean"))
        assert len(tasks.collect()) > 3
        assert made.count() == one.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError):
        rng.in_ranges(one, lambda d: d, rows=10, halo=11)


def test_equity_of_ranges(spark):
    rnd = random.Random(3)
    regimes = [rnd.choice([0, 1, 2, 2]) for _ in range(400)]
    rets = [rnd.gauss(0, 0.02) for _ in range(400)]
    rets[200], rets[300] = 2.5, 0.1
    lab = bt.positions(labels(spark, regimes, rets), 5)
    close_to(rng.equity(lab, 5, rows=64), bt.equity(lab, 5), ("symbol", "ret_index"))
    gone = bt.positions(labels(spark, [0] * 100, [0.1] * 50 + [1.0] + [0.1] * 49), 5)
    assert column(rng.equity(gone, 5, rows=16).orderBy("ts"), "equity")[-1] == 0.0


def folded(regimes, posts, min_train, dwell, hysteresis):
    held, count, stored, out = 1, 0, None, []
    for t, regime in enumerate(regimes):
        if t < min_train:
            out.append(0)
            continue
        p = posts[t] if posts else None
        if regime == held:
            count = 0
        else:
            count += 1
            sure = hysteresis <= 0 or p is None or stored is None or p[regime] - stored[held] > hysteresis
            if (dwell <= 0 or count >= dwell) and sure:
                held, count, stored = regime, 0, p
        out.append(held - 1)
    return out


@pytest.mark.parametrize(("dwell", "hysteresis", "fold"), [(1, 0.0, 8), (3, 0.0, 16), (3, 0.0, 256), (7, 0.0, 5), (0, 0.1, 8), (2, 0.05, 16), (4, 0.3, 7)])
def test_filters_by_blocks(spark, dwell, hysteresis, fold):
    rnd = random.Random(dwell)
    regimes = [1]
    for _ in range(299):
        regimes.append(regimes[-1] if rnd.random() < 0.7 else rnd.choice([0, 1, 2]))
    posts = [None if rnd.random() < 0.05 else list(map(float, np.round(np.random.RandomState(i).dirichlet([1, 1, 1]), 3))) for i in range(300)]
    df = labels(spark, regimes).unionByName(labels(spark, regimes[::-1], symbol="B"))
    if hysteresis:
        given = spark.createDataFrame([(s, i, p) for s in "AB" for i, p in enumerate(posts)], "symbol string, ret_index int, posterior array<double>")
        df = df.join(given, ["symbol", "ret_index"])
    got = bt.filtered_positions(df.repartition(3), 10, dwell, hysteresis, fold=fold)
    use = posts if hysteresis else None
    assert column(got, "position") == folded(regimes, use, 10, dwell, hysteresis) + folded(regimes[::-1], use, 10, dwell, hysteresis)


def test_filter_of_no_bars(spark):
    df = labels(spark, [0, 2, 2])
    assert column(bt.filtered_positions(df, 10, 2), "position") == [0, 0, 0]
    assert bt.filtered_positions(df.where("false"), 10, 2).count() == 0


def plain_cox(d, z, rounds=50):
    beta = np.zeros(2)
    for _ in range(rounds):
        grad, hess = np.zeros(2), np.diag([-1e-6, -1e-6])
        e = np.exp(z @ beta)
        for i in range(len(d)):
            risk = d >= d[i]
            s, m = e[risk].sum(), (e[risk, None] * z[risk]).sum(0) / e[risk].sum()
            grad += z[i] - m
            hess -= (e[risk, None, None] * z[risk][:, :, None] * z[risk][:, None, :]).sum(0) / s - np.outer(m, m)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return beta


def test_cox_equals_plain_newton(spark):
    rnd = np.random.RandomState(2)
    rows, want = [], {}
    for symbol in "AB":
        x, y = rnd.normal(size=80), rnd.normal(size=80)
        d = np.ceil(rnd.exponential(np.exp(-0.5 * x + 0.3 * y)) * 9).astype(int)
        z = np.stack([(v - v.mean()) / v.std() for v in (x, y)], 1)
        want[symbol] = plain_cox(d, z)
        rows += [(symbol, i, 1, int(d[i]), True, float(x[i]), float(y[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, spell int, regime int, duration int, event boolean, volatility double, total_log_return double")
    for r in sv.cox_fit(df).collect():
        assert np.allclose([r.beta_volatility, r.beta_return], want[r.symbol], atol=1e-6)
    assert sv.cox_fit(df.where("false")).collect() == []


def test_weibull_state_is_distinct_durations(spark):
    runs = spark.createDataFrame([("A", k, 0, 1 + k % 7, False, DAY0) for k in range(500)], "symbol string, spell int, regime int, duration int, censored boolean, since timestamp")
    plan = sv.weibull_fit(runs)
    d = np.array([1 + k % 7 for k in range(500)], float)
    k = plan.first().shape
    assert abs((d**k * np.log(d)).sum() / (d**k).sum() - 1 / k - np.log(d).mean()) < 1e-8 and math.isclose(plan.first().scale, (d**k).mean() ** (1 / k), rel_tol=1e-9)


def test_sweep_with_filter_columns(spark):
    rnd = random.Random(8)
    rows = [(s, DAY0 + datetime.timedelta(days=i), i, rnd.gauss(0.0005, 0.02)) for s in "AB" for i in range(330)]
    rets = spark.createDataFrame(rows, "symbol string, ts timestamp, ret_index int, ret double").repartition(3).cache()
    parameters = {"window": [5, 20], "threshold": [0.05], "dwell": [0, 3], "lead": [0.0, 0.12]}
    grid = ev.factorial_grid(spark, parameters, {"window": 20, "threshold": 0.05, "dwell": 0, "lead": 0.0})
    got = {(r.symbol, r.window, r.dwell, r.lead): r for r in ev.sweep_filters(rets, grid, 40).collect()}
    assert len(got) == 16 and sum(r.is_default for r in got.values()) == 2
    last = by_time().rowsBetween(-19, 0)
    for window in (5, 20):
        lab = rg.classify_threshold(rets, window, 0.05)
        lab = lab.withColumn("posterior", F.array(*[F.count_if(F.col("regime") == k).over(last) / 20 for k in range(3)])).cache()
        for dwell, lead in ((0, 0.0), (3, 0.0), (0, 0.12), (3, 0.12)):
            for want in bt.metrics(bt.equity(bt.filtered_positions(lab, 40, dwell, lead), 40)).collect():
                r = got[want.symbol, window, dwell, lead]
                for c in ("total_return", "sharpe", "max_drawdown", "n_trades", "win_rate", "profit_factor"):
                    assert (r[c] is None and want[c] is None) or math.isclose(r[c], want[c], rel_tol=1e-9, abs_tol=1e-12), (c, dwell, lead)
