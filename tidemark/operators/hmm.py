"""Hidden-Markov regimes: walk-forward fits fanned out over the cluster.

A fit is one key (symbol, refit, config). The unit of work is a group of a symbol's
refits under one configuration: its features come to a task once, and the group's
fits go through the recursions together, an array step for all of them. Groups share
nothing, so symbols, groups, configurations and seeds run side by side. Everything
after the fits (labels, continuity, carrying forward, selection) is DataFrame work on
the models' rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_TRAIN, REFIT_EVERY, MAX_ITER, TOL = 252, 50, 30, 1e-4
#: So many refits of a symbol are fitted together.
GROUP = 16
#: A fit of three or more states has collapsed if one of them holds less of the bars.
COLLAPSED = 0.05
MODELS = "symbol string, refit int, config_id int, seed int, n_states int, state int, weight double, mean_return double, mean array<double>, p double, loglik double, iterations int, n int, n_features int, occupancy double, ok boolean"
SALIENCY = "symbol string, refit int, config_id int, seed int, feature string, rho double"


def refit_schedule(rets: DataFrame, every: int = REFIT_EVERY, min_train: int = MIN_TRAIN, reverse: bool = False) -> DataFrame:
    """(symbol, refit): the first bar with ``min_train`` before it, every so many
    from there, and the last bar; in reverse from the last bar down, and the first. A
    fit at t sees feature rows before t, in reverse those from t on."""
    last = rets.groupBy("symbol").agg(F.max("ret_index").alias("last")).where(F.col("last") >= min_train)
    steps = F.array_union(F.sequence(F.col("last"), F.lit(min_train), F.lit(-every)), F.array(F.lit(min_train))) if reverse else F.array_union(F.sequence(F.lit(min_train), F.col("last"), F.lit(every)), F.array("last"))
    return last.select("symbol", F.explode(steps).alias("refit"))


def training_slices(features: DataFrame, columns: list[str], refits: DataFrame, reverse: bool = False) -> DataFrame:
    """(symbol, refits, x, reverse): a symbol's packed feature rows and a group of its
    refits. A fit takes the rows [0, refit), or from the refit on in the reverse
    variant. Gaps before a first value take the next one."""
    packed = features.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ret_index", F.array(*[F.col(c).cast("double") for c in columns]).alias("x")))).alias("rows"))
    numbered = refits.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("symbol").orderBy("refit")) - 1) / GROUP))
    groups = numbered.groupBy("symbol", "part").agg(F.sort_array(F.collect_list("refit")).alias("refits"))
    return packed.select("symbol", F.transform("rows", lambda r: r["x"]).alias("x")).join(groups, "symbol").select("symbol", "refits", "x", F.lit(reverse).alias("reverse"))


def _matrix(rows):
    import numpy as np

    return np.array([[math.nan if v is None else v for v in r] for r in rows], float)


def _clean(x):
    """The slice with gaps filled from the next row, then with 0."""
    import numpy as np

    if not len(x):
        raise ValueError("no rows to fit")
    x = np.where(np.isfinite(x), x, np.nan)
    at = np.where(np.isnan(x), len(x), np.arange(len(x))[:, None])
    at = np.minimum.accumulate(at[::-1])[::-1]
    filled = np.take_along_axis(np.vstack([x, np.zeros(x.shape[1])]), at, 0)
    return np.where(np.isnan(filled), 0.0, filled)


def _whiten(z, share):
    """Principal components to a share of the variance, scaled to unit variance, and
    the component that weighs the first feature most."""
    import numpy as np

    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True).reshape(z.shape[1], -1))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 1e-12), vectors[:, order]
    keep = int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
    vectors = vectors[:, :keep] / np.sqrt(values[:keep])
    return z @ vectors, int(np.argmax(np.abs(vectors[0])))


def _log_emission(x, means, variances):
    """Log densities (rows of x, states), as matrix products."""
    import numpy as np

    w = 1 / variances
    return -0.5 * (np.log(2 * np.pi * variances).sum(1) + x**2 @ w.T - 2 * (x @ (means * w).T) + (means**2 * w).sum(1))


def _forward_backward(jobs):
    """Per job (log emissions, start, transitions): state posteriors, summed
    transition posteriors and the log likelihood (scaled recursions after Rabiner
    1989). All jobs have as many states and take each step together; beyond a job's
    end emissions are 1, which leaves the rest as it is."""
    import numpy as np

    n, size, k = max(len(j[0]) for j in jobs), len(jobs), jobs[0][0].shape[1]
    b, shifts = np.ones((n, size, k)), []
    for i, (log_b, _, _) in enumerate(jobs):
        shift = log_b.max(1, keepdims=True)
        b[: len(log_b), i] = np.exp(log_b - shift)
        shifts.append(shift.sum())
    start, trans = np.array([j[1] for j in jobs]), np.array([j[2] for j in jobs])
    a, scale = np.empty((n, size, k)), np.empty((n, size, 1))
    row = start * b[0]
    for t in range(n):
        if t:
            row = np.matmul(a[t - 1][:, None], trans)[:, 0] * b[t]
        np.maximum(row.sum(1, keepdims=True), 1e-300, out=scale[t])
        np.divide(row, scale[t], out=a[t])
    b /= scale
    beta = np.ones((n, size, k))
    for t in range(n - 2, -1, -1):
        np.matmul(trans, (b[t + 1] * beta[t + 1])[:, :, None], out=beta[t][:, :, None])
    gamma = a * beta
    gamma /= gamma.sum(2, keepdims=True)
    b *= beta
    out = []
    for i, (log_b, _, _) in enumerate(jobs):
        m = len(log_b)
        out.append((gamma[:m, i], trans[i] * (a[: m - 1, i].T @ b[1:m, i]), float(np.log(scale[:m, i]).sum() + shifts[i])))
    return out


def _together(fits: list) -> list:
    """Results of generators that ask for ``_forward_backward`` of a job at a time, or
    the numerical error that one ended with."""
    out, jobs = [None] * len(fits), {}

    def step(i, answer):
        try:
            jobs[i] = fits[i].send(answer)
        except StopIteration as end:
            out[i] = end.value
        except (ValueError, ArithmeticError, IndexError) as error:
            out[i] = error

    for i in range(len(fits)):
        step(i, None)
    while jobs:
        now, asked = list(jobs), list(jobs.values())
        jobs.clear()
        for i, answer in zip(now, _forward_backward(asked), strict=True):
            step(i, answer)
    return out


def _alone(fit):
    out = _together([fit])[0]
    if isinstance(out, Exception):
        raise out
    return out


def _start(x, k, seed):
    """Means by farthest-first draws and a few k-means steps."""
    import numpy as np

    rnd = np.random.RandomState(seed)
    means = x[[rnd.randint(len(x))]]
    while len(means) < k:
        d = ((x[:, None] - means) ** 2).sum(2).min(1)
        means = np.vstack([means, x[rnd.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rnd.randint(len(x))]])
    for _ in range(10):
        near = ((x[:, None] - means) ** 2).sum(2).argmin(1)
        means = np.array([x[near == s].mean(0) if (near == s).any() else means[s] for s in range(k)])
    return means


def fit_gaussian(x, k, seed=42, iterations=MAX_ITER, tol=TOL):
    """Diagonal Gaussian HMM by Baum-Welch: (start, trans, means, variances, gamma,
    log likelihoods)."""
    return _alone(gaussian_steps(x, k, seed, iterations, tol))


def gaussian_steps(x, k, seed=42, iterations=MAX_ITER, tol=TOL):
    import numpy as np

    means, variances = _start(x, k, seed), np.tile(x.var(0) + 1e-3, (k, 1))
    start, trans, path = np.full(k, 1 / k), np.full((k, k), 0.2 / max(1, k - 1)) + np.eye(k) * (0.8 - 0.2 / max(1, k - 1)), []
    if k == 1:
        trans = np.ones((1, 1))
    square = x**2
    for _ in range(iterations):
        gamma, xi, ll = yield _log_emission(x, means, variances), start, trans
        path.append(ll)
        mass = gamma.sum(0)[:, None] + 1e-12
        start = gamma[0]
        trans = xi + 1e-12
        trans /= trans.sum(1, keepdims=True)
        means = gamma.T @ x / mass
        variances = np.maximum(gamma.T @ square / mass - means**2, 1e-3)
        if len(path) > 1 and path[-1] - path[-2] < tol:
            break
    gamma, _, ll = yield _log_emission(x, means, variances), start, trans
    return start, trans, means, variances, gamma, [*path, ll]


def huber(x, means, variances, gamma, k=1.345, rounds=10, tol=1e-6):
    """Means and variances reweighted by k / distance where the Mahalanobis distance
    from the state's mean is above k."""
    import numpy as np

    means, variances = means.copy(), variances.copy()
    for _ in range(rounds):
        old = means.copy()
        for s in range(len(means)):
            d = np.sqrt((((x - means[s]) ** 2) / variances[s]).sum(1))
            w = gamma[:, s] * np.where(d > k, k / np.maximum(d, 1e-12), 1.0)
            means[s] = w @ x / (w.sum() + 1e-12)
            variances[s] = np.maximum(w @ (x - means[s]) ** 2 / (w.sum() + 1e-12), 1e-3)
        if np.abs(means - old).max() < tol:
            break
    return means, variances


def mcd(x, means, variances, gamma, least=0.3, most=200, seed=0):
    """Per state, mean and variances of the half of its points (posterior over
    ``least``, at most ``most`` of them) with the smallest covariance determinant, by
    concentration steps from several starts."""
    import numpy as np

    means, variances, rnd = means.copy(), variances.copy(), np.random.RandomState(seed)
    for s in range(len(means)):
        own = x[gamma[:, s] > least]
        own = own[rnd.choice(len(own), most, replace=False)] if len(own) > most else own
        n, d = own.shape
        h = (n + d + 1) // 2
        if n < max(10, d + 2) or h >= n:
            continue
        best = None
        for _ in range(10):
            subset = rnd.choice(n, h, replace=False)
            for _ in range(20):
                m = own[subset].mean(0)
                cov = np.cov(own[subset].T).reshape(d, d) + 1e-6 * np.eye(d)
                dist = np.einsum("ij,jk,ik->i", own - m, np.linalg.inv(cov), own - m)
                new = np.argsort(dist)[:h]
                if set(new) == set(subset):
                    break
                subset = new
            det = np.linalg.slogdet(cov)[1]
            if best is None or det < best[0]:
                best = (det, m, np.diag(cov), np.median(dist))
        means[s], variances[s] = best[1], np.maximum(best[2] * best[3] / max(d - 0.67, 0.45), 1e-3)
    return means, variances


def fit_saliency(x, k, seed=42, iterations=50, tol=TOL, weight=1.0):
    """Feature-saliency HMM (after Adams, Beling and Cogill 2016): a feature follows
    its state's Gaussian with probability rho, else one common Gaussian; rho has a
    prior that costs ``weight`` per unit. Returns as ``fit_gaussian``, and rho."""
    return _alone(saliency_steps(x, k, seed, iterations, tol, weight))


def saliency_steps(x, k, seed=42, iterations=50, tol=TOL, weight=1.0):
    import numpy as np

    n, d = x.shape
    start, trans, means, variances, _, _ = yield from gaussian_steps(x, k, seed, 5)
    back_m, back_v, rho, path, flat = x.mean(0), x.var(0) + 1e-3, np.full(d, 0.5), [], 0
    normal = lambda v, m, s: np.exp(-0.5 * (v - m) ** 2 / s) / np.sqrt(2 * np.pi * s)
    for _ in range(iterations):
        own = rho * normal(x[:, None], means, variances) + 1e-300
        other = (1 - rho) * normal(x, back_m, back_v)[:, None] + 1e-300
        gamma, xi, ll = yield np.log(own + other).sum(2), start, trans
        path.append(ll)
        flat = flat + 1 if len(path) > 1 and abs(path[-1] - path[-2]) < tol * max(1.0, abs(path[-1])) else 0
        if flat >= 3:
            break
        u = gamma[:, :, None] * own / (own + other)
        v = gamma[:, :, None] - u
        mass = u.sum(0) + 1e-12
        means = (u * x[:, None]).sum(0) / mass
        variances = np.maximum((u * (x[:, None] - means) ** 2).sum(0) / mass, 1e-3)
        rest = v.sum((0, 1)) + 1e-12
        back_m = (v.sum(1) * x).sum(0) / rest
        back_v = np.maximum((v.sum(1) * (x - back_m) ** 2).sum(0) / rest, 1e-3)
        total = n + weight
        rho = np.clip((total - np.sqrt(np.maximum(total**2 - 4 * weight * u.sum((0, 1)), 0))) / (2 * weight), 0, 1) if weight else u.sum((0, 1)) / n
        start = gamma[0]
        trans = xi + 1e-12
        trans /= trans.sum(1, keepdims=True)
    return start, trans, means, variances, gamma, path, rho


def _fit_steps(rows, n_states, seed, engine, pca, robust, decode):
    """Fit one slice and score its last row: by ``last_bar`` from the start
    probabilities and its own emission alone, by ``filtered`` given all rows. Returns
    (rows of ``MODELS`` after the keys, saliency per feature or None)."""
    import numpy as np

    x = _clean(rows)
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    sort = 0
    if pca:
        z, sort = _whiten(z, pca)
    rho = None
    if engine == "fshmm":
        start, trans, means, variances, gamma, path, rho = yield from saliency_steps(z, n_states, seed)
    else:
        start, trans, means, variances, gamma, path = yield from gaussian_steps(z, n_states, seed)
        if robust:
            means, variances = (huber if robust == "huber" else mcd)(z, means, variances, gamma)
    log_p = np.log(start + 1e-300) + _log_emission(z[-1:], means, variances)[0]
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    if decode == "filtered":
        p = gamma[-1]
    share = np.bincount(gamma.argmax(1), minlength=n_states) / len(z)
    by = x[:, 0] @ gamma / (gamma.sum(0) + 1e-12) if pca else means[:, sort]
    out = [(n_states, s, float(start[s]), float(by[s]), [float(v) for v in means[s]], float(p[s]), float(path[-1]), len(path), len(z), z.shape[1], float(share[s]), True) for s in range(n_states)]
    return out, rho


def fit_slice(rows, n_states, seed=42, engine="hmm", pca=None, robust=None, decode="last_bar"):
    return _alone(_fit_steps(_matrix(rows), n_states, seed, engine, pca, robust, decode))


def fit_refits(rows, refits, reverse, n_states, *how, recover=False) -> dict:
    """Per refit what ``fit_slice`` returns, or the error of a fit that failed. With
    ``recover`` three or more states are first tried on all rows: if that fit has
    collapsed, the whole run is made with two."""
    rows = _matrix(rows)
    slices = [rows[t:] if reverse else rows[:t] for t in refits]
    trial = [rows] if recover and n_states >= 3 else []
    found = _together([_fit_steps(x, n_states, *how) for x in trial + slices])
    if trial:
        whole, *found = found
        if not isinstance(whole, Exception) and min(state[10] for state in whole[0]) < COLLAPSED:
            found = _together([_fit_steps(x, 2, *how) for x in slices])
    return dict(zip(refits, found, strict=True))


def _work(slices: DataFrame, configs: DataFrame) -> DataFrame:
    """Groups of refits under each of the few configurations, dealt out singly."""
    n = 4 * int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slices.crossJoin(F.broadcast(configs)).repartition(n, "symbol", F.col("refits")[0], "config_id", "seed")


def fit_models(slices: DataFrame, configs: DataFrame, decode: str = "last_bar", recover: bool = False) -> DataFrame:
    """Fit every slice under every row of ``configs(config_id, engine, n_states, seed,
    pca, robust)``. A row per state (``MODELS``); a fit that fails gives one row with
    ok = false. With ``recover`` a symbol whose fit on all rows collapses is fitted with
    two states."""

    def run(frames):
        import pandas as pd

        names = [c.split()[0] for c in MODELS.split(", ")]
        for frame in frames:
            out = []
            for r in frame.itertuples():
                found = fit_refits(r.x, list(r.refits), r.reverse, r.n_states, r.seed, r.engine, r.pca or None, r.robust or None, decode, recover=recover)
                for refit, fit in found.items():
                    key = (r.symbol, refit, r.config_id, r.seed)
                    if isinstance(fit, Exception):
                        out.append((*key, r.n_states, None, None, None, None, None, None, 0, 0, 0, None, False))
                    else:
                        out += [(*key, *state) for state in fit[0]]
            yield pd.DataFrame(out, columns=names)

    work = _work(slices, configs).select("symbol", "refits", "reverse", "config_id", "seed", "engine", "n_states", F.coalesce("pca", F.lit(0.0)).alias("pca"), F.coalesce("robust", F.lit("")).alias("robust"), "x")
    return work.mapInPandas(run, MODELS)


def fit_saliencies(slices: DataFrame, configs: DataFrame, columns: list[str]) -> DataFrame:
    """(keys, feature, rho) of feature-saliency fits of ``configs(config_id, n_states,
    seed)``; a fit that fails gives no rows."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                for refit, fit in fit_refits(r.x, list(r.refits), r.reverse, r.n_states, r.seed, "fshmm", None, None, "last_bar").items():
                    if not isinstance(fit, Exception):
                        out += [(r.symbol, refit, r.config_id, r.seed, c, float(v)) for c, v in zip(columns, fit[1], strict=True)]
            yield pd.DataFrame(out, columns=["symbol", "refit", "config_id", "seed", "feature", "rho"])

    return _work(slices, configs).select("symbol", "refits", "reverse", "config_id", "seed", "n_states", "x").mapInPandas(run, SALIENCY)


def select_by_saliency(saliencies: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(symbol, refit, config_id, seed, feature, rho) of the features whose saliency is at
    least the threshold; of a fit without one, the most salient."""
    best = Window.partitionBy(*FIT).orderBy(F.desc("rho"), "feature")
    ranked = saliencies.withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("rho") >= threshold) | (F.col("rank") == 1)).drop("rank")


FIT = ("symbol", "refit", "config_id", "seed")


def empirical_models(labels: DataFrame, refits: DataFrame, config_id: int = 1, recent: int = 20) -> DataFrame:
    """Models read off given labels instead of fitted, as rows of ``MODELS``: at each of
    ``refits(symbol, refit)`` a state per regime with the mean return and the share of
    its bars before the refit, and as posterior its share of the last ``recent``."""
    before = Window.partitionBy("symbol").orderBy("ret_index").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("symbol").orderBy("ret_index").rowsBetween(-recent, -1)
    own = lambda k: F.col("regime") == k
    state = lambda k: F.struct(F.lit(k).alias("state"), F.count_if(own(k)).over(before).alias("bars"), F.sum(F.when(own(k), F.col("ret"))).over(before).alias("total"), F.try_divide(F.count_if(own(k)).over(last), F.count("*").over(last)).alias("p"))
    rows = labels.select("symbol", F.col("ret_index").alias("refit"), F.count("*").over(before).alias("n"), F.array(*[state(k) for k in range(3)]).alias("states"))
    rows = rows.join(refits, ["symbol", "refit"]).select("symbol", "refit", "n", F.explode("states").alias("s"))
    mean, share = F.coalesce(F.try_divide("s.total", "s.bars"), F.lit(0.0)), F.try_divide("s.bars", "n")
    made = {"config_id": F.lit(config_id), "seed": F.lit(0), "n_states": F.lit(3), "state": F.col("s.state"), "weight": share, "mean_return": mean, "mean": F.array(mean), "p": F.col("s.p"), "loglik": F.lit(None), "iterations": F.lit(0), "n_features": F.lit(1), "occupancy": share, "ok": F.lit(True)}
    rows = rows.withColumns(made)
    return rows.select(*[F.col(name).cast(kind) for name, kind in (c.split() for c in MODELS.split(", "))])


def snapshot_classify(models: DataFrame, saliencies: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per symbol: regime and posteriors of a fit on all bars, without a walk
    forward, and its saliencies' mean, least, most, number selected and number."""
    one = bucket_posteriors(label_map(models)).select("symbol", F.col("bucket").alias("regime"), "p_bear", "p_sideways", "p_bull")
    facts = saliencies.groupBy("symbol").agg(F.avg("rho").alias("saliency_mean"), F.min("rho").alias("saliency_min"), F.max("rho").alias("saliency_max"), F.count_if(F.col("rho") >= threshold).alias("n_selected"), F.count("*").alias("total_features"))
    return one.join(facts, "symbol")


def label_map(models: DataFrame) -> DataFrame:
    """Add bucket: states in order of mean return fall into bear, sideways and bull;
    one state is sideways, two are bear and bull."""
    rank = F.row_number().over(Window.partitionBy(*FIT).orderBy("mean_return", "state")) - 1
    n = F.col("n_states")
    return models.where("ok").withColumn("bucket", F.when(n == 1, 1).when(n == 2, rank * 2).otherwise(F.least(F.lit(2), F.floor(rank * 3 / n).cast("int"))).cast("int"))


def _posterior_sums():
    sums = [F.sum(F.when(F.col("bucket") == b, F.col("p")).otherwise(0.0)).alias(f"p_{n}") for b, n in enumerate(("bear", "sideways", "bull"))]
    return [F.max_by(F.struct("state", "bucket"), F.struct("p", -F.col("state"))).alias("top"), *sums, F.max("loglik").alias("loglik")]


def bucket_posteriors(mapped: DataFrame) -> DataFrame:
    """One row per fit: the likeliest state and its bucket, and posteriors by bucket."""
    return mapped.groupBy(*FIT).agg(*_posterior_sums()).select(*FIT, F.col("top.state").alias("raw_state"), F.col("top.bucket").alias("bucket"), "p_bear", "p_sideways", "p_bull", "loglik")


def _with_matches(own: DataFrame, reverse: bool) -> DataFrame:
    """``own`` with ``now``, the states of a fit, and the map ``matched`` from them."""
    w = Window.partitionBy("symbol", "config_id", "seed").orderBy(F.desc("refit") if reverse else "refit")
    own = own.withColumn("before", F.lag("now").over(w))
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    pairs = F.array_sort(F.flatten(F.transform("now", lambda a: F.transform("before", lambda b: F.struct(d2(a["mean"], b["mean"]).alias("d"), a["state"].alias("a"), b["state"].alias("b"), b["bucket"].alias("bucket"))))))
    take = lambda acc, p: F.when(F.exists(acc, lambda q: (q["a"] == p["a"]) | (q["b"] == p["b"])), acc).otherwise(F.concat(acc, F.array(p)))
    empty = F.expr("cast(array() as array<struct<d: double, a: int, b: int, bucket: int>>)")
    fits = (F.size("before") == F.size("now")) & (F.size(F.get("before", F.lit(0))["mean"]) == F.size(F.get("now", F.lit(0))["mean"]))
    matched = F.when(F.coalesce(fits, F.lit(False)), F.aggregate(pairs, empty, take)).otherwise(empty)
    return own.withColumn("matched", F.map_from_entries(F.transform(matched, lambda p: F.struct(p["a"], p["bucket"]))))


STATES_NOW = "sort_array(collect_list(struct(state, mean, bucket)))"


def match_states(mapped: DataFrame) -> DataFrame:
    """Per fit, the bucket of the likeliest state by continuity: new states take, the
    nearest pair first, the states of the refit before by distance of their means, and
    with them their buckets; without a refit before, or with other sizes, their own."""
    return _with_matches(mapped.groupBy(*FIT).agg(F.expr(STATES_NOW).alias("now")), False).select(*FIT, "matched")


def scored_and_matched(mapped: DataFrame, reverse: bool = False) -> DataFrame:
    """``bucket_posteriors`` with the regime of ``match_states``, in one grouping; in
    reverse the refit before is the later one."""
    own = mapped.groupBy(*FIT).agg(*_posterior_sums(), F.expr(STATES_NOW).alias("now"))
    own = _with_matches(own, reverse)
    return own.select(*FIT, F.coalesce(F.try_element_at("matched", F.col("top.state")), F.col("top.bucket")).alias("regime"), "p_bear", "p_sideways", "p_bull", "loglik")


def remap_to_previous(scored: DataFrame, matched: DataFrame) -> DataFrame:
    out = scored.join(matched, list(FIT))
    return out.withColumn("regime", F.coalesce(F.try_element_at("matched", F.col("raw_state")), F.col("bucket"))).drop("matched")


def carry_forward(rets: DataFrame, scored: DataFrame, columns=("regime", "p_bear", "p_sideways", "p_bull"), reverse: bool = False, min_train: int = MIN_TRAIN) -> DataFrame:
    """Each bar takes the values of its symbol's latest refit at or before it, in reverse
    of the next one at or after it, from ``min_train`` on; regime is sideways elsewhere.
    ``scored`` holds one configuration and seed."""
    rows = rets.join(scored.select("symbol", F.col("refit").alias("ret_index"), *columns), ["symbol", "ret_index"], "left")
    w = Window.partitionBy("symbol").orderBy("ret_index")
    if reverse:
        known = {c: F.when(F.col("ret_index") >= min_train, F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))) for c in columns}
    else:
        known = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    return rows.withColumns(known).withColumn("regime", F.coalesce("regime", F.lit(1)))


def select_states_bic(models: DataFrame) -> DataFrame:
    """(symbol, refit, n_states, bic): the number of states with the least
    -2 LL + (2 K D + K (K - 1)) ln n over the seeds' best fits."""
    one = models.where("ok").groupBy(*FIT, "n_states").agg(F.max("loglik").alias("ll"), F.max("n").alias("n"), F.max("n_features").alias("d"))
    k = F.col("n_states")
    best = one.groupBy("symbol", "refit", "n_states").agg(F.max("ll").alias("ll"), F.max("n").alias("n"), F.max("d").alias("d"))
    bic = -2 * F.col("ll") + (2 * k * F.col("d") + k * (k - 1)) * F.ln("n")
    return best.withColumn("bic", bic).groupBy("symbol", "refit").agg(F.min_by("n_states", F.struct("bic", "n_states")).alias("n_states"), F.min("bic").alias("bic"))


def precheck_collapse(models: DataFrame, floor: float = COLLAPSED) -> DataFrame:
    """Per fit, whether a state of three or more holds less than ``floor`` of the bars;
    such fits are to be made again with two states."""
    return models.where("ok").groupBy(*FIT, "n_states").agg(F.min("occupancy").alias("least")).withColumn("collapsed", (F.col("n_states") >= 3) & (F.col("least") < floor))


def midstream_collapse(labels: DataFrame, min_train: int = MIN_TRAIN, floor: float = COLLAPSED, after: int = 20) -> DataFrame:
    """Per bar from ``min_train`` on, whether after ``after`` labels a regime has held
    less than ``floor`` of them so far."""
    w = Window.partitionBy("symbol").orderBy("ret_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = labels.where(F.col("ret_index") >= min_train)
    n = F.count("*").over(w)
    share = [F.count_if(F.col("regime") == r).over(w) / n for r in range(3)]
    return rows.withColumn("collapsed", (n >= after) & (F.least(*share) < floor))


def recovery_audit(labels: DataFrame, models: DataFrame, n_states: int = 3, every: int = REFIT_EVERY, min_train: int = MIN_TRAIN) -> DataFrame:
    """(symbol, original_n_states, n_states, auto_recovered, degeneration_bar): whether
    a symbol's run was made with two states since its trial collapsed, and the first
    refit at which the labels so far had collapsed, null if none or not looked for."""
    used = models.where("ok").groupBy("symbol").agg(F.max("n_states").cast("long").alias("n_states"))
    last = F.max("ret_index").over(Window.partitionBy("symbol"))
    seen = midstream_collapse(labels, min_train).withColumn("refit", (F.pmod(F.col("ret_index") - min_train, F.lit(every)) == 0) | (F.col("ret_index") == last))
    # The check at a refit sees the labels before it.
    before = F.lag("collapsed").over(Window.partitionBy("symbol").orderBy("ret_index"))
    first = seen.withColumn("before", before).where("refit and before").groupBy("symbol").agg(F.min("ret_index").cast("long").alias("bar"))
    out = used.join(first, "symbol", "left")
    return out.select("symbol", F.lit(n_states).cast("long").alias("original_n_states"), "n_states", (F.col("n_states") < n_states).alias("auto_recovered"), F.when(F.col("n_states") >= 3, F.col("bar")).alias("degeneration_bar"))


def walk_forward_labels(rets: DataFrame, features: DataFrame, columns: list[str], configs: DataFrame, every: int = REFIT_EVERY, min_train: int = MIN_TRAIN, recover: bool = True, reverse: bool = False, decode: str = "last_bar") -> tuple[DataFrame, DataFrame]:
    """(labels, models) of one configuration. A symbol whose trial fit collapses is
    fitted with two states. ``reverse`` goes from the last bar down and trains on what
    follows each refit, so it looks ahead; its labels say so in the column lookahead."""
    refits = refit_schedule(rets, every, min_train, reverse) if reverse else refit_schedule(rets, every, min_train)
    models = fit_models(training_slices(features, columns, refits, reverse), configs, decode, recover)
    scored = scored_and_matched(label_map(models), reverse)
    return carry_forward(rets, scored, reverse=reverse, min_train=min_train).withColumn("lookahead", F.lit(reverse)), models


#: Default configurations: (engine, states, PCA share, robust method, refit interval).
ENGINES = {"hmm": ("hmm", 3, None, None, 50), "messina": ("hmm", 3, 0.95, None, 50), "robust_hmm": ("hmm", 3, 0.90, "huber", 100), "fshmm": ("fshmm", 3, None, None, 100)}


def engine_config(spark, name: str, seed: int = 42) -> tuple[DataFrame, int]:
    engine, states, pca, robust, every = ENGINES[name]
    return spark.createDataFrame([(1, engine, states, seed, pca, robust)], "config_id int, engine string, n_states int, seed int, pca double, robust string"), every


#: Filters that an engine's runs use where a filter is given as "auto": (bars to dwell,
#: least lead of the posterior).
AUTO_FILTERS = {"threshold": (3, 0.0), "hmm": (0, 0.0), "messina": (0, 0.0), "robust_hmm": (0, 0.0), "fshmm": (2, 0.05)}


def auto_filters(engine: str, dwell="auto", hysteresis="auto") -> tuple[int, float]:
    """The filters of a run, each as given or the engine's own."""
    own = AUTO_FILTERS[engine]
    return own[0] if dwell == "auto" else dwell, own[1] if hysteresis == "auto" else hysteresis
