"""Stored models, whitening by refit and keyed appends against numpy and plain code."""

import math

import numpy as np
import pytest

from tidemark.operators import hmm
from tidemark.operators import models as md
from tidemark.operators import whitening as wh
from tidemark.sources import bars as src


def frame(spark, x, symbol="A"):
    names = [f"f{d}" for d in range(x.shape[1])]
    rows = [(symbol, t, *[None if math.isnan(v) else float(v) for v in row]) for t, row in enumerate(x)]
    return names, spark.createDataFrame(rows, "symbol string, ret_index int, " + ", ".join(f"{c} double" for c in names)).repartition(3)


def normal(x, mean, variance):
    return np.exp(-0.5 * (np.log(2 * np.pi * variance) + (x - mean) ** 2 / variance).sum())


def test_scores_of_a_fit_are_its_own(spark):
    """The last bar of a slice, scored by the stored model of a fit on that slice."""
    rnd = np.random.RandomState(1)
    x = np.concatenate([rnd.normal(m, 0.5, (60, 2)) for m in (-2, 0, 3, -2)])
    own, _ = hmm.fit_slice(x, 3, 42)
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    start, trans, means, variances, gamma, _ = hmm._alone(hmm.gaussian_steps(z, 3, 42))
    states = [(k, float(start[k]), means[k].tolist(), variances[k].tolist(), trans[k].tolist()) for k in range(3)]
    names, bars = frame(spark, x)
    model = spark.createDataFrame([("A", len(x), len(x), names, x.mean(0).tolist(), (x.std(0) + 1e-8).tolist(), states)], f"symbol string, refit int, n int, columns array<string>, center array<double>, scale array<double>, states array<{md.STATE}>")
    (got,) = md.score_bars(bars, model, names, ahead=1).collect()
    assert got.ret_index == len(x) - 1 and np.allclose(got.posterior, [r[5] for r in own], atol=1e-9)
    # From the first bar on, a model's filtered scores are its forward recursion.
    early = model.withColumn("refit", md.F.lit(0))
    found = {r.ret_index: r.posterior for r in md.filter_bars(bars, early, names).collect()}
    p = None
    for t in range(len(x)):
        p = (start if p is None else p @ trans) * [normal(z[t], means[k], variances[k]) for k in range(3)]
        p = p / p.sum()
        assert np.allclose(found[t], p, atol=1e-8)
    assert np.allclose(found[len(x) - 1], gamma[-1], atol=1e-6)


def test_models_of_labels_and_unseen_bars(spark):
    rnd = np.random.RandomState(2)
    x = rnd.normal(size=(120, 2)) * [1.0, 50.0] + [0.0, 1000.0]
    x[5, 0] = np.nan
    regimes = rnd.randint(0, 2, 120)  # the third state has no bars
    names, bars = frame(spark, x)
    lab = spark.createDataFrame([("A", t, int(r)) for t, r in enumerate(regimes)], "symbol string, ret_index int, regime int")
    refits = spark.createDataFrame([("A", 40), ("A", 100), ("B", 40)], "symbol string, refit int")
    made = {r.refit: r for r in md.models_of_labels(lab, bars, names, refits).collect()}
    assert set(made) == {40, 100}
    for t, model in made.items():
        kept = [i for i in range(t) if i != 5]
        own, r = x[kept], regimes[kept]
        assert model.n == len(kept) and np.allclose(model.center, own.mean(0)) and np.allclose(model.scale, own.std(0) + 1e-8)
        z = (own - own.mean(0)) / (own.std(0) + 1e-8)
        for k in (0, 1):
            s = model.states[k]
            assert math.isclose(s.start, (r == k).mean()) and np.allclose(s.mean, z[r == k].mean(0)) and np.allclose(s.variance, z[r == k].var(0))
            moves = np.array([sum((a, b) == (k, j) for a, b in zip(r, r[1:], strict=False)) for j in range(3)])
            assert np.allclose(s.to, (moves + 1) / (moves.sum() + 3))
        assert model.states[2].start == 0 and model.states[2].variance == [1.0, 1.0]
    stored = md.models_of_labels(lab, bars, names, refits).cache()
    scored = {r.ret_index: r for r in md.score_bars(bars, stored, names).collect()}
    assert set(scored) == set(range(40, 120)) and {r.refit for t, r in scored.items() if t >= 100} == {100}
    m = made[100]
    z = (x[110] - m.center) / m.scale
    p = np.array([m.states[k].start * normal(z, np.array(m.states[k].mean), np.array(m.states[k].variance)) for k in range(3)])
    assert np.allclose(scored[110].posterior, p / p.sum(), atol=1e-9)


def test_whitening_of_refits(spark):
    rnd = np.random.RandomState(3)
    x = rnd.normal(size=(200, 5)) @ rnd.normal(size=(5, 5)) + 1e6
    x[7, 2] = np.nan
    names, bars = frame(spark, x)
    refits = spark.createDataFrame([("A", t) for t in (1, 50, 120, 199)] + [("B", 50)], "symbol string, refit int")
    sums = wh.refit_sums(bars, names, refits).cache()
    for r in wh.covariances(sums, names).collect():
        own = np.delete(x, 7, 0)[: r.refit - (r.refit > 7)]
        assert r.n == len(own) and math.isclose(r.covariance, np.cov(own.T, bias=True)[r.i, r.j], rel_tol=1e-6, abs_tol=1e-8)
    rows = wh.whitening(sums, names, 0.9).collect()
    assert {r.symbol for r in rows} == {"A"} and {r.refit for r in rows} == {1, 50, 120, 199}
    for t in (50, 120, 199):
        own = np.delete(x, 7, 0)[: t - 1]
        z = (own - own.mean(0)) / own.std(0)
        parts = sorted((r for r in rows if r.refit == t), key=lambda r: r.component)
        values = np.linalg.eigvalsh(np.cov(z.T, bias=True))[::-1]
        assert np.allclose([r.variance for r in parts], values, rtol=1e-5, atol=1e-7)
        assert [r.kept for r in parts] == [bool(c < 0.9) for c in np.concatenate([[0], np.cumsum(values / values.sum())[:-1]])]
        white = z @ np.array([r.weights for r in parts]).T
        assert np.allclose(np.cov(white.T, bias=True), np.eye(5), atol=1e-3)


def test_results_are_added_once(spark, tmp_path):
    path, keys = f"{tmp_path}/all", ["symbol", "config_id"]
    rows = spark.createDataFrame([("A", 1, 0.5), ("A", 2, 0.6), ("B", 1, 0.7), ("B", 1, 0.7)], "symbol string, config_id int, sharpe double")
    assert src.append_results(rows, path, keys) == 3
    assert src.append_results(rows, path, keys) == 0
    more = spark.createDataFrame([("B", 1, 9.0), ("B", 2, 0.8)], rows.schema)
    assert src.append_results(more, path, keys) == 1
    assert sorted(tuple(r) for r in src.read_results(spark, path, keys).collect()) == [("A", 1, 0.5), ("A", 2, 0.6), ("B", 1, 0.7), ("B", 2, 0.8)]
    assert src.append_results(rows.where("false"), path, keys) == 0
    left = src.skip_done(spark.createDataFrame([("A", 1), ("C", 1)], "symbol string, config_id int"), src.read_results(spark, path, keys), keys)
    assert [tuple(r) for r in left.collect()] == [("C", 1)]
