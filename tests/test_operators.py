"""Operators on small frames with values worked out by hand or by plain code."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import recurrences as rec
from tidemark.functions.scalar import gamma
from tidemark.operators import backtest as bt
from tidemark.operators import diagnostics as diag
from tidemark.operators import evaluation as ev
from tidemark.operators import hmm
from tidemark.operators import regimes as rg
from tidemark.operators import survival as sv
from tidemark.plans import queries
from tidemark.sources import bars as src

DAY0 = datetime.datetime(2020, 1, 1)


def series(spark, values, name="x", symbols=("A",)):
    rows = [(s, DAY0 + datetime.timedelta(days=i), i, None if v is None else float(v)) for s in symbols for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, ts timestamp, ret_index int, {name} double").repartition(3)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def labels(spark, regimes, rets=None, symbol="A"):
    rets = rets or [0.0] * len(regimes)
    rows = [(symbol, DAY0 + datetime.timedelta(days=i), i, float(x), int(r)) for i, (r, x) in enumerate(zip(regimes, rets, strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, ret_index int, ret double, regime int")


def test_wilder_by_hand(spark):
    got = column(rec.wilder(series(spark, [10, 12, 11, 14, 13, 15, 16, 14, 17, 18]), "y", "x", 3), "y")
    assert got[:2] == [None, None] and math.isclose(got[2], 11) and math.isclose(got[3], 12)


@pytest.mark.parametrize("n", [2, 20])
def test_recurrences_over_many_blocks(spark, n):
    rnd = np.random.RandomState(0)
    x = list(rnd.standard_normal(2500) + 5)
    x[7] = None
    df = series(spark, x, symbols=("A", "B"))
    got = [v for v in column(rec.ema(df, "y", "x", n), "y") if v is not None]
    a, y, want, seen = 2 / (n + 1), None, [], 0
    for v in x:
        if v is not None:
            y, seen = v if y is None else y + a * (v - y), seen + 1
            if seen >= n:
                want.append(y)
    assert np.allclose(got, want * 2, rtol=1e-12)
    got = [v for v in column(rec.ewm_adjusted(df, "y", "x", n), "y") if v is not None]
    num = den = 0.0
    want = []
    for v in x:
        if v is not None:
            num, den = num * (1 - a) + v, den * (1 - a) + 1
            want.append(num / den)
    assert np.allclose(got, want * 2, rtol=1e-12)


def gapped(spark, n=300):
    rnd = np.random.RandomState(4)
    close = [None if i in (0, 9, 50, 51, 52, 170) else 100 + float(v) for i, v in enumerate(rnd.standard_normal(n).cumsum())]
    rows = [("A", DAY0 + datetime.timedelta(days=i), i, v, None if v is None else v + 1, None if v is None else v - 1) for i, v in enumerate(close)]
    return close, spark.createDataFrame(rows, "symbol string, ts timestamp, bar_index int, close double, high double, low double").repartition(3)


def plain_ema(values, n, adjusted=False):
    a, y, num, den, seen, out = 2 / (n + 1), None, 0.0, 0.0, 0, []
    for v in values:
        if v is None:
            out.append(None)
            continue
        seen += 1
        y = v if y is None else y + a * (v - y)
        num, den = num * (1 - a) + v, den * (1 - a) + 1
        out.append(num / den if adjusted else y if seen >= n else None)
    return out


def same(got, want):
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-10)


def test_recurrences_pass_over_gaps(spark):
    close, df = gapped(spark)
    df = df.cache()
    same(column(rec.ewm_adjusted(df, "y", "close", 7), "y"), plain_ema(close, 7, True))
    same(column(rec.ema(df, "y", "close", 7), "y"), plain_ema(close, 7))
    minus = lambda a, b: [None if x is None or y is None else x - y for x, y in zip(a, b, strict=True)]
    line = minus(plain_ema(close, 12), plain_ema(close, 26))
    made = rec.macd(df)
    same(column(made, "macd"), line)
    same(column(made, "macd_signal"), plain_ema(line, 9))
    kel = rec.keltner(df)
    same(column(kel, "keltner_middle"), plain_ema(close, 20, True))
    upper = column(kel, "keltner_upper")
    assert all(u is None for u, c in zip(upper, close, strict=True) if c is None) and all(u > m for u, m in zip(upper, column(kel, "keltner_middle"), strict=True) if u is not None)
    same(column(rec.wilder(series(spark, [1, 2, 3, None, None, 5, 4]), "y", "x", 2), "y"), [None, 1.5, 2.25, None, None, 3.625, 3.8125])


def test_threshold_is_strict_and_symbols_do_not_leak(spark):
    df = series(spark, [0.03, 0.02, 0.0, 0.001, -0.2], "ret", ("A", "B"))
    assert column(rg.classify_threshold(df, 2, 0.05), "regime") == [1, 1, 1, 1, 0] * 2
    assert column(rg.classify_threshold(series(spark, [0.03, 0.021], "ret"), 2, 0.05), "regime") == [1, 2]


def test_markov_of_one_regime(spark):
    m = rg.matrix_row(rg.transition_matrix(labels(spark, [1, 1, 1, 1]))).first()
    assert math.isclose(m.p00, 1 / 3) and m.p11 > 0.999999 and math.isclose(m.p10 + m.p11 + m.p12, 1)
    pi = rg.stationary(rg.matrix_row(rg.transition_matrix(labels(spark, [0, 1, 2, 0, 2, 2, 1, 0])))).first()
    t = np.array([[r.p for r in rg.transition_matrix(labels(spark, [0, 1, 2, 0, 2, 2, 1, 0])).where(f"from_regime = {i}").orderBy("to_regime").collect()] for i in range(3)])
    assert np.allclose(np.array(pi[1:]) @ t, pi[1:])


def test_spells_and_transitions(spark):
    lab = labels(spark, [0, 0, 1, 1, 1, 2, 2])
    got = [(r.regime, r.duration, r.censored) for r in rg.spells(lab).orderBy("spell").collect()]
    assert got == [(0, 2, False), (1, 3, False), (2, 2, True)]
    assert [(r.from_regime, r.to_regime, r.ret_index) for r in rg.transitions(lab).orderBy("ts").collect()] == [(0, 1, 2), (1, 2, 5)]


def test_backtest_by_hand(spark):
    # Long, straight to short, then flat: one trade; a lost bar of 100 % ends at zero.
    lab = labels(spark, [2, 0, 1, 1], [0.5, 0.1, 0.2, 0.3])
    rows = bt.equity(bt.positions(lab, 0), 0)
    assert np.allclose(column(rows, "equity"), [1, 1.1, 1.1 * 0.8, 1.1 * 0.8])
    t = bt.trades(rows).collect()
    assert not t  # it starts in a position, so no bar without one precedes it
    lab = labels(spark, [1, 2, 0, 1, 2], [0, 0.1, 0.1, 0.2, 0.1])
    m = bt.metrics(bt.equity(bt.positions(lab, 0), 0)).first()
    assert m.n_trades == 2 and m.win_rate == 0.0 and m.profit_factor is not None
    gone = bt.equity(bt.positions(labels(spark, [0, 1, 1], [0.0, 1.0, 0.5]), 0), 0)
    assert column(gone, "equity") == [1.0, 0.0, 0.0]
    flat = bt.metrics(bt.equity(bt.positions(labels(spark, [1] * 5), 0), 0)).first()
    assert flat.sharpe == 0.0 and flat.n_trades == 0 and flat.profit_factor is None
    short = bt.metrics(bt.equity(bt.positions(labels(spark, [1] * 5), 252), 252)).first()
    assert short.sharpe is None and short.total_return is None


def test_filters(spark):
    lab = labels(spark, [2, 2, 0, 1, 0, 0, 0])
    assert column(bt.filtered_positions(lab, 0, 2), "position") == [0, 1, 1, -0 + 0, 0, -1, -1]
    post = lab.withColumn("posterior", F.array(F.lit(0.3), F.lit(0.3), F.lit(0.4)))
    assert column(bt.filtered_positions(post, 0, 0, 0.2), "position") == [1] * 7


def test_weibull(spark):
    rnd = np.random.RandomState(1)
    d = np.ceil(rnd.weibull(2.0, 500) * 300).astype(int)
    runs = spark.createDataFrame([("A", i, 0, int(v), i == 499) for i, v in enumerate(d)], "symbol string, spell int, regime int, duration int, censored boolean")
    fit = sv.weibull_fit(runs).first()
    assert abs(fit.shape - 2) < 0.15 and abs(fit.scale - 300) < 20
    f = sv.duration_forecast(runs).first()
    t = np.linspace(f.days_in_regime, 5000, 400_000)
    s = np.exp(-((t / f.weibull_scale) ** f.weibull_shape))
    area = float(((s[1:] + s[:-1]) / 2 * np.diff(t)).sum() / s[0])
    assert math.isclose(f.expected_remaining_days, area, rel_tol=1e-3)
    few = spark.createDataFrame([("A", 0, 0, 5, False), ("A", 1, 0, 5, False)], runs.schema)
    assert sv.weibull_fit(few).first().shape is None
    same = spark.createDataFrame([("A", i, 0, 5, False) for i in range(4)], runs.schema)
    assert sv.weibull_fit(same).first()[3:] == (1.0, 5.0)


def test_cox_finds_the_sign(spark):
    rnd = np.random.RandomState(2)
    x = rnd.standard_normal(300)
    rows = [("A", i, 0, int(max(1, 100 * rnd.exponential() * math.exp(-0.8 * v))), True, float(v), float(rnd.standard_normal())) for i, v in enumerate(x)]
    fit = sv.cox_fit(spark.createDataFrame(rows, "symbol string, spell int, regime int, duration int, event boolean, volatility double, total_log_return double")).first()
    assert 0.55 < fit.beta_volatility < 1.05 and abs(fit.beta_return) < 0.2 and fit.concordance > 0.65


def test_gamma(spark):
    xs = [1.0, 1.5, 2.0, 3.7, 11.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.gamma(x) for x in xs], rtol=1e-12)


def test_verdicts(spark):
    rows = [("a", 2, 0.5, 0.2, 0.6, 0.1), ("b", 2, 0.5, 0.6, 0.2, 0.1), ("c", 0, -0.4, 0.6, 0.2, 0.1), ("d", 0, -0.4, 0.2, 0.6, 0.1), ("e", 1, 0.05, 0.3, 0.3, 0.1), ("f", 1, 0.05, 0.3, 0.3, 0.03), ("g", 1, -0.2, 0.3, 0.3, 0.1)]
    got = {r.symbol: r.verdict for r in diag.verdict(spark.createDataFrame(rows, "symbol string, regime int, signal double, f_bear double, f_bull double, threshold double")).collect()}
    assert got == {"a": "bullish", "b": "transition_bear", "c": "bearish", "d": "transition_bull", "e": "neutral", "f": "transition_bull", "g": "transition_bear"}


def test_csv_source(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-01,1,2,0.5,1,10\n2020-01-02,1,2,0.5,1.5,10\n2020-01-03,1,2,0.5,n/a,10\n")
    got = src.read_bars_csv(spark, str(tmp_path)).orderBy("bar_index").collect()
    assert [(r.symbol, r.bar_index, r.close) for r in got] == [("ABC", 0, 1.0), ("ABC", 1, 1.5)]
    assert [r.problem for r in src.validate_bars(src.read_bars_csv(spark, str(tmp_path)), 3).collect()] == ["fewer than 3 rows"]


def test_csv_files_by_their_own_headers(spark, tmp_path):
    pd = pytest.importorskip("pandas")
    days = [f"2021-03-{d:02d}" for d in range(1, 21)]
    full = pd.DataFrame({"Date": days, "Open": range(20), "High": range(1, 21), "Low": range(-1, 19), "Close": [i + 0.5 for i in range(20)], "Volume": range(100, 120)})
    full.to_csv(tmp_path / "A.csv", index=False)
    full[["Close", "Volume", "Date", "Low", "High", "Open"]].rename(columns={"Close": " LAST ", "Volume": "vol", "Date": "Timestamp"}).to_csv(tmp_path / "B.csv", index=False)
    # Not all five: the close is what a name holds, here the adjusted one.
    pd.DataFrame({"trade date": days, "note": "x", "Adj Close": [2.0 * i for i in range(20)], "Price, raw": 7}).to_csv(tmp_path / "C d.csv", index=False)
    # No name tells of a close: the first column but the date that holds numbers alone.
    pd.DataFrame({"when": days, "text": ["1", "b", *["3"] * 18], "value": [3.0 * i for i in range(20)], "other": 1}).to_csv(tmp_path / "D.csv", index=False)
    (tmp_path / "E.csv").write_text('\ufeff"Close","Date"\n"1.5","2021-03-01 10:00"\n\n2.5,2021-03-02\n')
    rows = [tuple(r) for r in src.read_bars_csv(spark, str(tmp_path)).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume", "bar_index").collect()]
    by = lambda s: sorted((r[1:] for r in rows if r[0] == s), key=lambda r: r[-1])
    want = [(d, float(i), i + 1.0, i - 1.0, i + 0.5, i + 100.0, i) for i, d in enumerate(days)]
    assert by("A") == want and by("B") == want
    assert by("C d") == [(d, None, None, None, 2.0 * i, None, i) for i, d in enumerate(days)]
    assert by("D") == [(d, None, None, None, 3.0 * i, None, i) for i, d in enumerate(days)]
    assert by("E") == [("2021-03-01", None, None, None, 1.5, None, 0), ("2021-03-02", None, None, None, 2.5, None, 1)]
    assert {r[0] for r in rows} == {"A", "B", "C d", "D", "E"}
    (tmp_path / "F.csv").write_text("date,what\n2021-03-01,x\n")
    with pytest.raises(ValueError, match="F.csv"):
        src.read_bars_csv(spark, str(tmp_path))


def test_csv_round_trip_in_two_orders(spark, tmp_path):
    bars = src.index_panel(spark, "/root/testdata/sf0.001").drop("bar_index").cache()
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    for k, names in enumerate((["ts", "open", "high", "low", "close", "volume"], ["volume", "close", "low", "ts", "high", "open"])):
        for symbol in [r.symbol for r in bars.select("symbol").distinct().orderBy("symbol").collect()][k::2]:
            one = bars.where(F.col("symbol") == symbol).withColumn("ts", stamp).select(*[F.col(c).alias("time" if c == "ts" else c) for c in names])
            (tmp_path / f"{symbol}.csv").write_text("\n".join([",".join(one.columns), *[",".join(map(str, r)) for r in one.collect()]]))
    back = src.read_bars_csv(spark, str(tmp_path)).drop("bar_index")
    assert back.count() == bars.count() and back.exceptAll(bars.select(back.columns)).isEmpty()


def test_grid_and_resume(spark):
    grid = ev.factorial_grid(spark, {"a": [1, 2], "b": [3, 4]}, {"a": 1, "b": 4})
    assert grid.count() == 4 and grid.where("is_default").count() == 1
    assert ev.one_at_a_time(spark, {"a": [1, 2], "b": [3, 4]}, {"a": 1, "b": 4}).count() == 3
    assert src.skip_done(grid, grid.where("a = 1"), ["config_id"]).count() == 2


def planted(n=400, seed=3):
    rnd = np.random.RandomState(seed)
    state = np.repeat(rnd.randint(0, 3, n // 20), 20)
    return state, np.c_[(state - 1) * 5 + rnd.standard_normal(n) * 0.5, rnd.standard_normal(n)]


def test_hmm_recovers_planted_states():
    state, x = planted()
    start, trans, means, variances, gamma, path = hmm.fit_gaussian(x, 3)
    assert all(b >= a - 1e-6 for a, b in zip(path, path[1:], strict=False)) and np.allclose(trans.sum(1), 1)
    order = np.argsort(means[:, 0])
    assert np.allclose(means[order, 0], [-5, 0, 5], atol=0.3)
    assert (np.argsort(order)[gamma.argmax(1)] == state).mean() > 0.98
    far = np.vstack([x, np.full((10, 2), 25.0)])
    g = np.vstack([gamma, np.tile(np.eye(3)[order[2]], (10, 1))])
    for fix in (hmm.huber, hmm.mcd):
        m, _ = fix(far, np.array([g[:, s] @ far / g[:, s].sum() for s in range(3)]), variances, g)
        assert abs(m[order[2], 0] - 5) < 1.0
    *_, rho = hmm.fit_saliency(x, 3)
    assert rho[0] > 0.8 and rho[0] > rho[1]


def test_labels_of_models(spark):
    row = lambda t, s, p, r, mean, k=3: ("A", t, 1, 42, k, s, 1 / k, r, mean, p, -1.0, 5, 100, 1, 0.3, True)
    models = spark.createDataFrame([row(10, 0, 0.2, 0.5, [5.0]), row(10, 1, 0.1, -0.5, [-5.0]), row(10, 2, 0.7, 0.0, [0.0]), row(20, 0, 0.6, -0.2, [5.1]), row(20, 1, 0.3, 0.4, [-4.9]), row(20, 2, 0.1, 0.1, [0.2])], hmm.MODELS)
    mapped = hmm.label_map(models)
    assert [r.bucket for r in mapped.orderBy("refit", "state").collect()] == [2, 0, 1, 0, 2, 1]
    scored = hmm.bucket_posteriors(mapped)
    assert [(r.bucket, round(r.p_bear, 3), round(r.p_bull, 3)) for r in scored.orderBy("refit").collect()] == [(1, 0.1, 0.2), (0, 0.6, 0.3)]
    out = hmm.remap_to_previous(scored, hmm.match_states(mapped)).orderBy("refit").collect()
    assert [r.regime for r in out] == [1, 2]  # state 0 of the second fit is where the first one's bull state was
    two = spark.createDataFrame([row(10, 0, 0.4, 0.5, [5.0], 2), row(10, 1, 0.6, -0.5, [-5.0], 2)], hmm.MODELS)
    assert [r.bucket for r in hmm.label_map(two).orderBy("state").collect()] == [2, 0]


def test_walk_forward_alone_and_in_a_panel(spark):
    state, x = planted(320)
    rows = [(s, DAY0 + datetime.timedelta(days=i), i, float(v[0]), float(v[0]), float(v[1])) for s in ("A", "B") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, ret_index int, ret double, f0 double, f1 double")
    config, _ = hmm.engine_config(spark, "hmm")
    r, f = df.select("symbol", "ts", "ret_index", "ret"), df.select("symbol", "ret_index", "f0", "f1")
    both, models = hmm.walk_forward_labels(r, f, ["f0", "f1"], config, 40, 252, decode="filtered")
    alone, _ = hmm.walk_forward_labels(r.where("symbol = 'A'"), f.where("symbol = 'A'"), ["f0", "f1"], config, 40, 252, decode="filtered")
    a = [(x.ret_index, x.regime) for x in both.where("symbol = 'A'").orderBy("ret_index").collect()]
    assert a == [(x.ret_index, x.regime) for x in alone.orderBy("ret_index").collect()]
    assert all(reg == 1 for t, reg in a if t < 252) and models.where("not ok").count() == 0
    at = {r.refit for r in models.select("refit").collect()}
    assert at == {252, 292, 319} and dict(a)[292] == state[291]


def test_concordance_counts_pairs(spark):
    rnd = random.Random(3)
    rows = [(s, 1, rnd.randint(1, 9), float(rnd.randint(0, 4))) for s in "AB" for _ in range(40)]
    got = {r.symbol: r.concordance for r in sv.concordance(spark.createDataFrame(rows, "symbol string, regime int, duration int, r double"), ["symbol", "regime"]).collect()}
    for s in "AB":
        pairs = [(a, b) for a in rows for b in rows if a[0] == b[0] == s and a[2] < b[2]]
        want = sum(1.0 if a[3] > b[3] else 0.5 if a[3] == b[3] else 0.0 for a, b in pairs) / len(pairs)
        assert math.isclose(got[s], want)


def test_cox_forecast_by_hand(spark):
    done = [(3, 0.1), (5, 0.2), (5, 0.1), (9, 0.4), (12, 0.2)]
    rows = [("A", k, 2, d, True, v, 0.0) for k, (d, v) in enumerate(done)] + [("A", 9, 2, 4, False, 0.3, 0.0)]
    cov = spark.createDataFrame(rows, "symbol string, spell int, regime int, duration long, event boolean, volatility double, total_log_return double")
    fits = spark.createDataFrame([("A", 2, 0.7, 0.0)], "symbol string, regime int, beta_volatility double, beta_return double")
    (got,) = sv.cox_forecast(cov, fits).collect()
    v = np.array([x for _, x in done])
    risk = lambda x: math.exp(0.7 * (x - v.mean()) / v.std())
    hazard = {t: sum(d == t for d, _ in done) / sum(risk(x) for d, x in done if d >= t) for t in (3, 5, 9, 12)}
    assert got.days_in_regime == 4 and math.isclose(got.baseline_hazard_at_t, hazard[5])
    s = {t: math.exp(-sum(h for u, h in hazard.items() if u <= t) * risk(0.3)) for t in (5, 9, 12)}
    assert math.isclose(got.cox_expected_remaining_days, ((s[5] + s[9]) / 2 * 4 + (s[9] + s[12]) / 2 * 3) / s[5])


def test_categories(spark):
    of = {"log_ret": "Returns", "sma_20": "Moving Averages", "ema_20": "Moving Averages", "atr_14": "Volatility", "bb_width": "Volatility", "donchian_upper": "Volatility", "keltner_upper": "Volatility", "rsi_14": "Momentum", "williams_r_14": "Momentum", "cci_20": "Momentum", "mfi_14": "Momentum", "obv": "Volume", "vwap": "Volume", "adx_14": "Trend", "aroon_up_25": "Trend", "di_plus_14": "Trend", "price_position_5": "Price Patterns", "hl_ratio_5": "Price Patterns", "day_of_week": "Time-based", "hour": "Time-based", "minute": "Time-based", "month_sin": "Time-based", "kdj_j": "Other"}
    got = spark.createDataFrame([(k,) for k in of], "feature string").select("feature", ev.feature_category().alias("c")).collect()
    assert {r.feature: r.c for r in got} == of


def test_auto_filters():
    assert hmm.auto_filters("fshmm") == (2, 0.05) and hmm.auto_filters("threshold", hysteresis=0.1) == (3, 0.1) and hmm.auto_filters("hmm", 4, 0.0) == (4, 0.0)


def test_fits_together_are_fits_alone():
    rnd = np.random.RandomState(5)
    rows = np.concatenate([rnd.standard_normal((150, 4)) + m for m in (-2, 0, 2, 0)]).tolist()
    for how in ((42, "hmm", None, None, "last_bar"), (42, "fshmm", None, None, "filtered"), (42, "hmm", 0.9, "huber", "last_bar")):
        both = hmm.fit_refits(rows, [200, 450, 600], False, 3, *how)
        for refit, (states, rho) in both.items():
            alone, alone_rho = hmm.fit_slice(rows[:refit], 3, *how)
            for a, b in zip(states, alone, strict=True):
                assert a[:2] == b[:2] and np.allclose(a[2:4], b[2:4]) and np.allclose(a[4], b[4]) and np.allclose(a[5:7], b[5:7])
            assert (rho is None) == (alone_rho is None) and (rho is None or np.allclose(rho, alone_rho))
    back = hmm.fit_refits(rows, [100, 599, 600], True, 3, 42, "hmm", None, None, "last_bar")
    assert back[100][0][0][8] == 500 and isinstance(back[600], ValueError)


def test_recovery_of_a_collapsed_run():
    rnd = np.random.RandomState(6)
    rows = np.concatenate([rnd.standard_normal((400, 2)), 50 + rnd.standard_normal((4, 2)), -rnd.standard_normal((400, 2)) + 9]).tolist()
    plain = hmm.fit_refits(rows, [300, 800], False, 3, 42, "hmm", None, None, "last_bar")
    safe = hmm.fit_refits(rows, [300, 800], False, 3, 42, "hmm", None, None, "last_bar", recover=True)
    assert {s[0] for s, _ in plain.values() for s in s} == {3} and {s[0] for s, _ in safe.values() for s in s} == {2}


def test_result_files(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("A", None, 1.5)], "symbol string, note string, sharpe double").coalesce(1)
    src.write_results_json(rows, f"{tmp_path}/json")
    (line,) = [x for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"symbol": "A", "note": None, "sharpe": 1.5}
    src.write_saliency(spark.createDataFrame([("f", 0.7), ("g", 0.2)], "feature string, rho double").coalesce(1), f"{tmp_path}/csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").orderBy("feature").collect()] == [("f", "0.7", "yes"), ("g", "0.2", "no")]
    for _ in range(2):
        src.append_results(rows, f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all").count() == 2


def test_drawdown_query_equals_sql_where_a_symbol_never_falls(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rng, rows = np.random.RandomState(3), []
    for flag, n in (("A", 400), ("B", 400), ("C", 20)):
        for day in range(n):
            # A's revenue swings, B's hardly ever moves: B holds no position and never falls.
            price = float(rng.randint(100, 9000)) if flag == "A" else 1000.0 + day % 2
            rows.append((day, 1.0, price, 0.0, flag, "O", DAY0 + datetime.timedelta(days=day)))
    lines = spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()["drawdown"])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    got = entry.queries()["drawdown"](spark, str(tmp_path)).select(*names).collect()
    assert [r[0] for r in sorted(want)] == ["AO"] and sorted(map(tuple, got)) == sorted(want)
    every = bt.drawdown(queries.held(spark, str(tmp_path))).collect()
    assert {r.symbol: r.max_duration > 0 for r in every} == {"AO": True, "BO": False}


def test_drawdown_query_keeps_the_symbol_of_null_flags(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'R')")).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()["drawdown"])
    names, want = [c[0] for c in found.description], found.fetchall()
    got = entry.queries()["drawdown"](spark, str(tmp_path)).select(*names).collect()
    assert [r[0] for r in want].count(None) == 1
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_drawdown_has_no_episode_where_no_position_is_held(spark):
    """Bars without a position leave the equity as it is, to the last digit, however many."""
    from fractions import Fraction

    rng, rows, want = np.random.RandomState(8), [], {}
    for s in range(40):
        total, peak, run, runs, held = Fraction(0), Fraction(0), 0, [], 0
        for k in range(700):
            if k % 50 == 0:
                held = rng.choice([-1, 0, 0, 1])
            ret = round(float(rng.normal(0, 0.02)), 6)
            rows.append((f"s{s}", DAY0 + datetime.timedelta(days=k), k, ret, int(held)))
            pnl = rows[-2][4] * ret if k else 0.0
            total += Fraction(math.log(1 + pnl))
            if total >= peak:
                runs, run, peak = runs + [run], 0, total
            else:
                run += 1
        runs.append(run)
        want[f"s{s}"] = (max(runs), sum(runs))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, ret_index int, ret double, position int")
    eq = bt.equity(bars, 0)
    got = {r.symbol: r for r in bt.drawdown(eq).collect()}
    assert {s: r.max_duration for s, r in got.items()} == {s: w[0] for s, w in want.items()}
    under = eq.withColumn("peak", F.expr("max(equity) over (partition by symbol order by ret_index)")).where("equity < peak")
    assert {r.symbol: r["count"] for r in under.groupBy("symbol").count().collect()} == {s: w[1] for s, w in want.items() if w[1]}
