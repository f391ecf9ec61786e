"""Queries over the single stages of a run, and their SQL: models read off labels,
filters, audits, summaries and the whole feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import backtest as bt
from tidemark.operators import diagnostics as diag
from tidemark.operators import evaluation as ev
from tidemark.operators import features as feat
from tidemark.operators import hmm
from tidemark.operators import models as md
from tidemark.operators import ranges as rng
from tidemark.operators import regimes as rg
from tidemark.operators import survival as sv
from tidemark.operators import whitening as wh
from tidemark.plans import checks as ck
from tidemark.plans import queries as qs
from tidemark.plans.checks import BARS_SQL, LABELS, MATRIX, NOW, RETS, SPELLS, WEIBULL, labelled, query, r
from tidemark.plans.queries import MIN_TRAIN, NUDGE, labels, panel, q, results, rets
from tidemark.sources import bars as src


def models(s, d, reverse=False):
    schedule = hmm.refit_schedule(rets(s, d), hmm.REFIT_EVERY, MIN_TRAIN, reverse)
    return hmm.label_map(hmm.empirical_models(labels(s, d), schedule))


def matched(s, d):
    pairs = F.explode(F.map_entries("matched")).alias("m")
    return hmm.match_states(models(s, d)).select("symbol", "refit", pairs).select("symbol", "refit", F.col("m.key").alias("state"), F.col("m.value").alias("bucket"))


def carried(s, d, reverse=False):
    out = hmm.carry_forward(rets(s, d), hmm.scored_and_matched(models(s, d, reverse), reverse), reverse=reverse, min_train=MIN_TRAIN)
    return out.select("symbol", "ts", "ret_index", "regime", "p_bear", "p_sideways", "p_bull")


def audit(s, d):
    schedule = hmm.refit_schedule(rets(s, d))
    return hmm.recovery_audit(labels(s, d), hmm.empirical_models(labels(s, d), schedule))


def with_posterior(s, d):
    """Labels with the shares of the last 20 as posterior."""
    from tidemark.functions.frames import by_time

    last = by_time().rowsBetween(-19, 0)
    return labels(s, d).withColumn("posterior", F.array(*[F.count_if(F.col("regime") == k).over(last) / 20 for k in range(3)]))


def hysteresis(s, d):
    return bt.filtered_positions(with_posterior(s, d), MIN_TRAIN, 2, 0.12).select("symbol", "ts", "ret_index", "position")


def flat_labels(s, d):
    """Threshold labels that never leave sideways: what the checks of results are for."""
    return rg.classify_threshold(rets(s, d), 20, 9.0)


def flat_problems(s, d):
    lab = flat_labels(s, d)
    held = bt.equity(bt.positions(lab, MIN_TRAIN), MIN_TRAIN)
    return diag.validate_results(rg.markov_stats(lab).join(bt.metrics(held), "symbol"))


def sparse_bars(s, d):
    """The order lines as unclean bars: several a day, some without a close."""
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    price = F.round(F.col("l_extendedprice").cast("double"), 2)
    close = F.when(F.col("l_quantity").cast("double") > 25, price)
    return lines.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), price.alias("open"), price.alias("high"), price.alias("low"), close.alias("close"), F.col("l_quantity").cast("double").alias("volume"))


SALIENT = ("price_position_5", "price_position_10", "price_position_20", "hl_ratio_5", "hl_ratio_10", "hl_ratio_20", "simple_ret", "sma_20", "volume_sma_20", "day_of_week")


def correlations(s, d):
    """A stand-in for saliencies that SQL has too: how strongly a feature goes with the
    next return. Fitted saliencies are in ``saliency_audit``."""
    p = ind.price_levels(panel(s, d)).withColumns({"simple_ret": ind.simple_return(), "sma_20": ind.sma(20), "volume_sma_20": ind.sma(20, "volume"), "day_of_week": F.weekday("ts").cast("double")})
    from tidemark.functions.frames import by_time

    p = p.withColumn("next", F.lead("close").over(by_time()) / F.col("close") - 1)
    long = p.select("symbol", "next", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in SALIENT])).alias("f")).select("symbol", "next", "f.*")
    return long.where("x is not null and next is not null").groupBy("symbol", "feature").agg(F.round(F.abs(F.corr("x", "next")), 8).alias("rho"))


def one_by_one(s, d):
    return ev.sweep_threshold(rets(s, d), ev.one_at_a_time(s, qs.GRID, qs.DEFAULT), MIN_TRAIN)


def runs_of_events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("engine"), F.col("value").cast("double").alias("seconds"))


def evaluated(s, d):
    """Two engines that share a panel, each with its own filters."""
    engines = {"threshold": labels(s, d), "threshold_40": rg.classify_threshold(rets(s, d), 40, 0.08)}
    return ev.evaluate(engines, MIN_TRAIN, {"threshold": hmm.auto_filters("threshold"), "threshold_40": (0, 0.0)})


def fitted_agreement(s, d):
    """The threshold engine against a fitted one."""
    fitted, _ = qs.hmm_labels(s, d, "messina")
    named = lambda df, name: df.select("symbol", F.lit(name).alias("engine"), "ret_index", "regime")
    return ev.engine_agreement(named(labels(s, d), "threshold").unionByName(named(fitted, "messina")))


def fitted_over_robust(s, d):
    """The robust engine against the plain one, both fitted."""
    robust, plain = (qs.hmm_labels(s, d, name)[0] for name in ("robust_hmm", "hmm"))
    return diag.over_robust_flag(rg.current(robust), rg.current(plain))


def fitted_audit(s, d):
    lab, made = qs.hmm_labels(s, d, "messina")
    return hmm.recovery_audit(lab, made)


SCORED = ["ret", "spread"]


def scored_columns(s, d):
    """What the stored models are scored on: returns and spreads of bars."""
    p = panel(s, d).select("symbol", (F.col("bar_index") - 1).cast("int").alias("ret_index"), ((F.col("high") - F.col("low")) / F.col("close")).alias("spread"), F.ln("volume").alias("log_volume"))
    return rets(s, d).select("symbol", "ret_index", "ret").join(p, ["symbol", "ret_index"])


def stored_models(s, d):
    return md.models_of_labels(labels(s, d), scored_columns(s, d), SCORED, hmm.refit_schedule(rets(s, d)))


def posteriors(df):
    return df.select("symbol", "ret_index", "refit", *[F.get("posterior", F.lit(k)).alias(f"p_{k}") for k in range(3)])


def moments(s, d):
    sums = wh.refit_sums(scored_columns(s, d), [*SCORED, "log_volume"], hmm.refit_schedule(rets(s, d)))
    return wh.covariances(sums, [*SCORED, "log_volume"]).withColumn("covariance", F.col("covariance") * 1e4)


def whitened(s, d):
    """The generic features' components at each of the plain engine's refits."""
    rows, features, columns = qs.hmm_inputs(s, d)
    filled = feat.backfill(features.withColumn("ts", F.col("ret_index")), columns)
    return wh.whitening(wh.refit_sums(filled, columns, hmm.refit_schedule(rows)), columns).drop("weights")


def flat_record(s, d):
    f = qs.assembled(s, d)
    cols = ["source", "engine", F.col("dates.start").alias("start"), F.col("dates.end").alias("end"), F.col("current_regime.name").alias("regime"), F.col("current_regime.index").alias("regime_index"), "signal"]
    cols += [F.col(f"{k}.{p}_{n}").alias(f"{p}_{n}") for k, p in (("stationary_distribution", "pi"), ("persistence_diagonal", "stay"), ("regime_counts", "n")) for n in rg.NAMES]
    cols += [F.col(f"walk_forward.{m}").alias(m) for m in ("sharpe", "max_drawdown", "n_trades", "win_rate", "profit_factor", "total_return")]
    return f.select(*cols, *[F.col("forecast")[F.lit(f"{k}_step")][f"f_{n}"].alias(f"f{k}_{n}") for k in (1, 5, 20) for n in rg.NAMES])


def each_rounded(df, places):
    """Features, each rounded as in the queries of its group."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        digits, nudge = places.get(name, (None, 0.0))
        if kind == "double" and digits is not None:
            c = F.round(c + F.lit(nudge * 10**-digits) if nudge else c, digits) + F.lit(0.0)
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)


MOVING = ("sma_20", "sma_13", "sma_200", "sma_ratio_50_200", "wma_10", "tma_20", "hma_16")
CHANNELS = ("true_range", "bb_middle", "true_range_pct", "atr_sma_14", "bb_upper", "bb_lower", "bb_width", "donchian_upper", "donchian_lower", "hist_vol", "donchian_middle", "bb_position")
MOMENTUM = ("roc_10", "mtm_10", "proc_12", "stoch_k_14", "williams_r_14", "stoch_d_3", "cci_20", "mfi_14", "aroon_up_25", "aroon_down_25", "dmi_plus_14", "dmi_minus_14", "aroon_oscillator_25", "dmi_adx_14")
VOLUME = ("volume_sma_20", "volume_ratio_20", "obv", "vwap")
TIMES = ("day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "hour_sin", "hour_cos")
RECURRENT = ("ema_20", "atr_14", "rsi_14", "di_plus_14", "di_minus_14", "di_spread", "adx_14", "adx_inflection")
GENERIC_DIGITS = dict.fromkeys(MOVING, (6, NUDGE)) | dict.fromkeys(CHANNELS + MOMENTUM, (5, NUDGE)) | dict.fromkeys(VOLUME + RECURRENT, (5, 0.0)) | dict.fromkeys(TIMES, (9, 0.0))
GENERIC_DIGITS |= {"volume_roc_10": (5, 0.0)} | {k: (6, 0.0) for k in ck.LEVELS} | {"adl": (2, 0.0), "vpt": (2, 0.0), "eom_14": (6, 0.0), "log_ret": (8, 0.0), "simple_ret": (8, 0.0)}

STOP = ("sma_13", "atr_20", "vstop", "price_vstop_ratio", "price_vstop_gap_atr")
CURATED_DIGITS = GENERIC_DIGITS | dict.fromkeys(STOP, (5, NUDGE)) | {"vstop_interaction": (0, 0.0), "kdj_j": (5, 0.0), "volume_ratio": (5, 0.0), "true_range_pct": (6, 0.0), "price_sma200_ratio": (5, NUDGE), "sma200_distance_atr": (4, NUDGE)}

QUERIES = {
    "label_map": q(lambda s, d: models(s, d).select("symbol", "refit", "state", "weight", "mean_return", "p", "bucket"), 8),
    "bucket_posteriors": q(lambda s, d: hmm.bucket_posteriors(models(s, d)).select("symbol", "refit", "raw_state", "bucket", "p_bear", "p_sideways", "p_bull"), 8),
    "match_states": q(matched),
    "remap_to_previous": q(lambda s, d: hmm.remap_to_previous(hmm.bucket_posteriors(models(s, d)), hmm.match_states(models(s, d))).select("symbol", "refit", "regime")),
    "precheck_collapse": q(lambda s, d: hmm.precheck_collapse(models(s, d), 0.25).select("symbol", "refit", "n_states", "least", "collapsed"), 8),
    "model_lookup": q(carried, 8),
    "reverse_labels": q(lambda s, d: carried(s, d, True), 8),
    "reverse_schedule": q(lambda s, d: hmm.refit_schedule(rets(s, d), reverse=True)),
    "recovery_audit": q(audit),
    "hysteresis_positions": q(hysteresis),
    "replay": q(lambda s, d: bt.replay(labels(s, d), MIN_TRAIN).select("symbol", "ts", "ret_index", "regime")),
    "insufficient_history": q(lambda s, d: bt.metrics(bt.equity(bt.positions(labels(s, d), 2440), 2440)), 6),
    "validate_flat_results": flat_problems,
    "clean_bars": q(lambda s, d: src.clean_bars(sparse_bars(s, d))),
    "drop_incomplete": q(lambda s, d: feat.drop_incomplete(panel(s, d).withColumn("sma_200", ind.sma(200)), ["sma_200"]).select("symbol", "ts", "sma_200"), 6, NUDGE),
    "one_at_a_time": q(one_by_one, 6),
    "filter_valid_results": q(lambda s, d: ev.filter_valid(bt.metrics(bt.equity(bt.positions(labels(s, d), 2440), 2440))), 6),
    "runtime_summary": q(lambda s, d: ev.runtime_summary(runs_of_events(s, d)), 5),
    "feature_correlations": q(correlations, 8),
    "saliency_summary": q(lambda s, d: ev.saliency_summary(correlations(s, d), 0.02), 6),
    "saliency_selection": q(lambda s, d: hmm.select_by_saliency(correlations(s, d).withColumns({"refit": F.lit(0), "config_id": F.lit(1), "seed": F.lit(0)}), 0.03).select("symbol", "feature", "rho"), 6),
    "category_summary": q(lambda s, d: ev.category_summary(ev.saliency_audit(correlations(s, d))), 6),
    "correlation_audit": q(lambda s, d: ev.saliency_audit(correlations(s, d)).drop("rank"), 6),
    "zscore_all_bars": q(lambda s, d: feat.zscore_expanding(panel(s, d).withColumn("log_ret", ind.log_return()), ["log_ret"]).withColumn("z_log_ret", F.when(F.col("bar_index") > 2, F.col("z_log_ret"))).select("symbol", "ts", "z_log_ret"), 4),
    "evaluate": q(evaluated, 6),
    "assembled_record": q(flat_record, 6),
    "features_generic": lambda s, d: each_rounded(feat.generic(panel(s, d)), GENERIC_DIGITS),
    "features_curated": lambda s, d: each_rounded(feat.curated(panel(s, d)).select("symbol", "ts", *feat.CURATED), CURATED_DIGITS),
    "cox_forecast": q(lambda s, d: sv.cox_forecast(rg.spell_covariates(labels(s, d)), sv.cox_fit(rg.spell_covariates(labels(s, d)))), 4),
    "engine_agreement_fitted": q(fitted_agreement),
    "over_robust_fitted": q(fitted_over_robust, 6),
    "recovery_audit_fitted": q(fitted_audit),
    "snapshot_classify": q(lambda s, d: snapshot(s, d), 6),
    "model_scores": q(lambda s, d: posteriors(md.score_bars(scored_columns(s, d), stored_models(s, d), SCORED)), 5),
    "model_filtered": q(lambda s, d: posteriors(md.filter_bars(scored_columns(s, d), stored_models(s, d), SCORED)), 5),
    "refit_moments": q(moments, 6),
    "pca_refits": q(whitened, 5),
    "features_generic_ranges": lambda s, d: each_rounded(rng.generic(panel(s, d), 1024, 600), GENERIC_DIGITS),
    "equity_ranges": q(lambda s, d: rng.equity(bt.positions(labels(s, d), MIN_TRAIN), MIN_TRAIN, 1024).select("symbol", "ts", "ret_index", "pnl", "equity"), 8),
}


def snapshot(s, d):
    """One feature-saliency fit a symbol, on all of its bars."""
    rows, features, columns = qs.hmm_inputs(s, d, "fshmm")
    whole = rows.groupBy("symbol").agg((F.max("ret_index") + 1).alias("refit"))
    slices = hmm.training_slices(features, columns, whole)
    config, _ = hmm.engine_config(s, "fshmm")
    return hmm.snapshot_classify(hmm.fit_models(slices, config), hmm.fit_saliencies(slices, config, columns))


# --- SQL -------------------------------------------------------------------------------

LAST = "(SELECT symbol, max(ret_index) AS last FROM rets GROUP BY symbol HAVING max(ret_index) >= 252)"
AHEAD = f"sched AS (SELECT DISTINCT symbol, CAST(t AS BIGINT) AS refit FROM (SELECT symbol, unnest(list_append(range(252, last + 1, 50), last)) AS t FROM {LAST}))"
BACK = f"sched AS (SELECT DISTINCT symbol, CAST(t AS BIGINT) AS refit FROM (SELECT symbol, unnest(list_append(range(last, 251, -50), 252)) AS t FROM {LAST}))"


def models_sql(reverse: bool = False) -> list[str]:
    b = "PARTITION BY symbol ORDER BY ret_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    w = "PARTITION BY symbol ORDER BY ret_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"
    stack = " UNION ALL ".join(
        f"SELECT symbol, ret_index AS refit, {k} AS state, count(*) OVER ({b}) AS n, count(*) FILTER (regime = {k}) OVER ({b}) AS bars, sum(ret) FILTER (regime = {k}) OVER ({b}) AS total, count(*) FILTER (regime = {k}) OVER ({w}) / count(*) OVER ({w}) AS p FROM labels"
        for k in range(3)
    )
    order = "DESC" if reverse else "ASC"
    return [
        BACK if reverse else AHEAD,
        f"stacked AS ({stack})",
        "mods AS (SELECT m.symbol, m.refit, state, bars / n AS weight, coalesce(total / nullif(bars, 0), 0) AS mean_return, p FROM stacked m JOIN sched USING (symbol, refit))",
        "mapped AS (SELECT *, row_number() OVER (PARTITION BY symbol, refit ORDER BY mean_return, state) - 1 AS bucket FROM mods)",
        "tops AS (SELECT symbol, refit, arg_max(state, (p, -state)) AS raw_state, arg_max(bucket, (p, -state)) AS bucket, sum(p) FILTER (bucket = 0) AS p_bear, sum(p) FILTER (bucket = 1) AS p_sideways, sum(p) FILTER (bucket = 2) AS p_bull FROM mapped GROUP BY symbol, refit)",
        f"befores AS (SELECT symbol, refit, lag(refit) OVER (PARTITION BY symbol ORDER BY refit {order}) AS prev FROM (SELECT DISTINCT symbol, refit FROM mapped))",
        "dist AS (SELECT a.symbol, a.refit, pow(a.mean_return - b.mean_return, 2) AS d, a.state AS sa, b.state AS sb, b.bucket FROM befores f JOIN mapped a ON a.symbol = f.symbol AND a.refit = f.refit JOIN mapped b ON b.symbol = f.symbol AND b.refit = f.prev)",
        "m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, refit ORDER BY d, sa, sb) AS k FROM dist) WHERE k = 1)",
        "m2 AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.symbol, x.refit ORDER BY x.d, x.sa, x.sb) AS k FROM dist x JOIN m1 ON m1.symbol = x.symbol AND m1.refit = x.refit AND m1.sa <> x.sa AND m1.sb <> x.sb) WHERE k = 1)",
        "m3 AS (SELECT x.*, 1 AS k FROM dist x JOIN m1 ON m1.symbol = x.symbol AND m1.refit = x.refit AND m1.sa <> x.sa AND m1.sb <> x.sb JOIN m2 ON m2.symbol = x.symbol AND m2.refit = x.refit AND m2.sa <> x.sa AND m2.sb <> x.sb)",
        "met3 AS (SELECT symbol, refit, sa AS state, bucket FROM m1 UNION ALL SELECT symbol, refit, sa, bucket FROM m2 UNION ALL SELECT symbol, refit, sa, bucket FROM m3)",
        "scored AS (SELECT t.symbol, t.refit, coalesce(m.bucket, t.bucket) AS regime, p_bear, p_sideways, p_bull FROM tops t LEFT JOIN met3 m ON m.symbol = t.symbol AND m.refit = t.refit AND m.state = t.raw_state)",
    ]


def carried_sql(reverse: bool = False) -> str:
    frame = "OVER (PARTITION BY l.symbol ORDER BY l.ret_index ROWS " + ("BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)" if reverse else "UNBOUNDED PRECEDING)")
    pick = lambda c: f"{'first' if reverse else 'last'}_value(s.{c} IGNORE NULLS) {frame}"
    seen = lambda c: f"CASE WHEN l.ret_index >= 252 THEN {pick(c)} END" if reverse else pick(c)
    cols = ", ".join(f"round({seen(c)}, 8) + 0.0 AS {c}" for c in ("p_bear", "p_sideways", "p_bull"))
    return labelled(f"SELECT l.symbol, l.ts, l.ret_index, CAST(coalesce({seen('regime')}, 1) AS BIGINT) AS regime, {cols} FROM labels l LEFT JOIN scored s ON s.symbol = l.symbol AND s.refit = l.ret_index", *models_sql(reverse))


OBSERVED = "obs AS (SELECT l.symbol, l.ret_index, l.regime, l.ret AS x0, (b.high - b.low) / b.close AS x1, ln(b.volume) AS x2 FROM labels l JOIN bars b ON b.symbol = l.symbol AND b.bar_index = l.ret_index + 1)"


def scored_sql() -> str:
    """Models from all bars before a refit, and each later bar's states by the latest."""
    both = lambda text: ", ".join(text.format(d=d) for d in (0, 1))
    past = "FROM sched s JOIN obs o ON o.symbol = s.symbol AND o.ret_index < s.refit"
    return labelled(
        "SELECT symbol, ret_index, refit, " + ", ".join(f"round(max(p) FILTER (state = {k}), 5) + 0.0 AS p_{k}" for k in range(3)) + " FROM shares GROUP BY symbol, ret_index, refit",
        AHEAD,
        OBSERVED,
        f"tot AS (SELECT s.symbol, s.refit, count(*) AS n, {both('avg(x{d}) AS c{d}, sqrt(greatest(avg(x{d} * x{d}) - avg(x{d}) * avg(x{d}), 0)) + 1e-8 AS s{d}')} {past} GROUP BY ALL)",
        f"st AS (SELECT s.symbol, s.refit, k AS state, count(*) FILTER (regime = k) AS bars, {both('avg(x{d}) FILTER (regime = k) AS a{d}, avg(x{d} * x{d}) FILTER (regime = k) AS q{d}')} {past}, range(3) AS t(k) GROUP BY ALL)",
        f"par AS (SELECT st.symbol, st.refit, state, bars / n AS start, {both('c{d}, s{d}, (coalesce(a{d}, c{d}) - c{d}) / s{d} AS m{d}, CASE WHEN bars > 0 THEN greatest((q{d} - a{d} * a{d}) / (s{d} * s{d}), 1e-6) ELSE 1.0 END AS v{d}')} FROM st JOIN tot USING (symbol, refit))",
        "look AS (SELECT o.symbol, o.ret_index, x0, x1, max(s.refit) AS refit FROM obs o JOIN sched s ON s.symbol = o.symbol AND s.refit <= o.ret_index GROUP BY ALL)",
        "dens AS (SELECT l.symbol, l.ret_index, l.refit, state, ln(start + 1e-300) - 0.5 * (" + " + ".join(f"ln(2 * pi() * v{d}) + pow((x{d} - c{d}) / s{d} - m{d}, 2) / v{d}" for d in (0, 1)) + ") AS lp FROM look l JOIN par USING (symbol, refit))",
        "tops2 AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY symbol, ret_index)) AS e FROM dens)",
        "shares AS (SELECT *, e / sum(e) OVER (PARTITION BY symbol, ret_index) AS p FROM tops2)",
    )


MOMENTS_SQL = labelled(
    " UNION ALL ".join(f"SELECT s.symbol, s.refit, count(*) AS n, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round(covar_pop(x{i}, x{j}) * 1e4, 6) + 0.0 AS covariance FROM sched s JOIN obs o ON o.symbol = s.symbol AND o.ret_index < s.refit GROUP BY s.symbol, s.refit" for i in range(3) for j in range(i, 3)),
    AHEAD,
    OBSERVED,
)

LATE = ck.backtest_sql("labels").replace("ret_index >= 252", "ret_index >= 2440")
ENOUGH = lambda c: f"CASE WHEN n_equity >= 2 THEN round({c}, 6) + 0.0 END AS {c}"
METRIC_NAMES = ("total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor")
LATE_SELECT = "SELECT e.symbol, coalesce(n_equity, 0) AS n_equity, " + ", ".join(ENOUGH("coalesce(max_drawdown, 0)").replace("AS coalesce(max_drawdown, 0)", "AS max_drawdown") if c == "max_drawdown" else ENOUGH(c) for c in METRIC_NAMES) + ", CASE WHEN n_equity >= 2 THEN coalesce(n_trades, 0) END AS n_trades FROM (SELECT DISTINCT symbol FROM labels) e LEFT JOIN met ON met.symbol = e.symbol"
DWELL3 = """fl AS (
  SELECT symbol, 251 AS t, 1 AS h, 0 AS c FROM (SELECT DISTINCT symbol FROM labels)
  UNION ALL
  SELECT n.symbol, n.ret_index, CASE WHEN n.regime <> h AND c + 1 >= 3 THEN n.regime ELSE h END, CASE WHEN n.regime = h OR c + 1 >= 3 THEN 0 ELSE c + 1 END
  FROM fl JOIN labels n ON n.symbol = fl.symbol AND n.ret_index = fl.t + 1),
dwelt AS (SELECT l.* EXCLUDE (regime), CASE WHEN l.ret_index >= 252 THEN h ELSE 1 END AS regime FROM labels l LEFT JOIN fl ON fl.symbol = l.symbol AND fl.t = l.ret_index)"""


def corr_sql() -> list[str]:
    levels = ", ".join(f"{x} AS {n}" for n, x in ck.LEVELS.items())
    wide = f"wide AS (SELECT symbol, lead(close) OVER {ck.W} / close - 1 AS nxt, {levels}, close / {ck.lag('close')} - 1 AS simple_ret, {ck.roll('avg', 'close', 20)} AS sma_20, {ck.roll('avg', 'volume', 20)} AS volume_sma_20, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week FROM bars)"
    return [wide, "corrs AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS feature, round(abs(corr({c}, nxt)), 8) AS rho FROM wide WHERE {c} IS NOT NULL AND nxt IS NOT NULL GROUP BY symbol" for c in SALIENT) + ")"]


CATEGORY = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{c}'" for c, fs in (("Price Patterns", SALIENT[:6]), ("Returns", SALIENT[6:7]), ("Moving Averages", SALIENT[7:9]), ("Time-based", SALIENT[9:]))) + " END"
AUDIT = f"aud AS (SELECT feature, {CATEGORY} AS category, avg(rho) AS mean, stddev_pop(rho) AS deviation, min(rho) AS least, max(rho) AS most, count(*) AS n FROM corrs GROUP BY feature)"


def joined(base: str, names: list[tuple[str, tuple[str, ...]]], select: str) -> str:
    """``base`` (a query with symbol and ts) joined to other queries' columns."""
    tables = "".join(f" LEFT JOIN ({ck.ORACLES[name] if name in ck.ORACLES else name}) t{k} ON t{k}.symbol = b.symbol AND t{k}.ts = b.ts" for k, (name, _) in enumerate(names))
    return f"SELECT {select}, " + ", ".join(f"t{k}.{c}" for k, (_, cs) in enumerate(names) for c in cs) + f" FROM ({base}) b{tables}"


CALENDAR = ("day_of_week", "day_of_month", "month", "quarter", "is_month_end", "is_month_start", "is_quarter_end", "hour", "minute", "session", "is_weekend", *TIMES)
TIMES_SQL = ck.ORACLES["time_features"].replace(ck.EVENTS, BARS_SQL).replace("FROM ev", "FROM bars")
MADE = query(BARS_SQL, select=f"SELECT symbol, ts, CAST(bar_index AS BIGINT) AS bar_index, open, high, low, close, volume, round(ln(close / {ck.lag('close')}), 8) + 0.0 AS log_ret, round(close / {ck.lag('close')} - 1, 8) + 0.0 AS simple_ret FROM bars")
ADX_COLUMNS = ("di_plus_14", "di_minus_14", "di_spread", "adx_14", "adx_inflection")
NODES = sv.NODES
AREA = f"""list_sum([CASE WHEN i = 0 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * exp(pow(t / scale, shape) - pow(t / scale + (i / {NODES}.0) / (1 - i / {NODES}.0), shape)) / pow(1 - i / {NODES}.0, 2) FOR i IN range({NODES})]) / {NODES}.0 / 3 * scale"""
LIFE = f"""life AS (SELECT r.symbol, r.regime, r.duration AS t, f.n, f.shape, f.scale FROM runs r LEFT JOIN fits f ON f.symbol = r.symbol AND f.regime = r.regime WHERE r.censored)"""

OWN = query(BARS_SQL, ck.TRB, ck.wilder("w2", "trb", "tr", 20), f"cb AS (SELECT b.*, w2.y AS a20, {ck.roll('avg', 'close', 200).replace('symbol ORDER BY ts', 'b.symbol ORDER BY b.ts')} AS m200, {ck.roll('avg', 'volume', 20).replace('symbol ORDER BY ts', 'b.symbol ORDER BY b.ts')} AS v20, lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS before FROM trb b LEFT JOIN w2 ON b.symbol = w2.symbol AND b.ts = w2.ts)", recursive=True,
    select=f"SELECT symbol, ts, round(ln(close / before), 8) + 0.0 AS log_ret, round(volume / nullif(v20, 0), 5) + 0.0 AS volume_ratio, round(tr / close, 6) + 0.0 AS true_range_pct, {ck.near('close / m200', 5, 'price_sma200_ratio')}, {ck.near('(close - m200) / a20', 4, 'sma200_distance_atr')} FROM cb")

ORACLES = {
    "features_curated": joined(OWN, [("moving_averages", ("sma_200",)), ("vstop", (*STOP, "vstop_trend", "vstop_interaction")), ("adx_wilder", ADX_COLUMNS), ("kdj", ("kdj_j",))], "b.*"),
    "label_map": labelled(f"SELECT symbol, refit, state, {r('weight', 8)}, {r('mean_return', 8)}, {r('p', 8)}, bucket FROM mapped", *models_sql()),
    "bucket_posteriors": labelled(f"SELECT symbol, refit, raw_state, bucket, {r('p_bear', 8)}, {r('p_sideways', 8)}, {r('p_bull', 8)} FROM tops", *models_sql()),
    "match_states": labelled("SELECT symbol, refit, state, bucket FROM met3", *models_sql()),
    "remap_to_previous": labelled("SELECT symbol, refit, regime FROM scored", *models_sql()),
    "precheck_collapse": labelled("SELECT symbol, refit, 3 AS n_states, round(min(weight), 8) + 0.0 AS least, min(weight) < 0.25 AS collapsed FROM mods GROUP BY symbol, refit", *models_sql()),
    "model_lookup": carried_sql(),
    "reverse_labels": carried_sql(True),
    "reverse_schedule": query(BARS_SQL, RETS, BACK, select="SELECT symbol, refit FROM sched"),
    "recovery_audit": labelled(
        "SELECT s.symbol, CAST(3 AS BIGINT) AS original_n_states, CAST(3 AS BIGINT) AS n_states, false AS auto_recovered, f.bar AS degeneration_bar FROM (SELECT DISTINCT symbol FROM sched) s LEFT JOIN (SELECT symbol, min(ret_index) AS bar FROM seen WHERE before AND ((ret_index - 252) % 50 = 0 OR ret_index = last) GROUP BY symbol) f ON f.symbol = s.symbol",
        AHEAD,
        "cnt AS (SELECT symbol, ret_index, count(*) OVER w AS n, count(*) FILTER (regime = 0) OVER w AS a, count(*) FILTER (regime = 1) OVER w AS b, count(*) FILTER (regime = 2) OVER w AS c FROM labels WHERE ret_index >= 252 WINDOW w AS (PARTITION BY symbol ORDER BY ret_index ROWS UNBOUNDED PRECEDING))",
        "seen AS (SELECT symbol, ret_index, max(ret_index) OVER (PARTITION BY symbol) AS last, lag(n >= 20 AND least(a, b, c) / n < 0.05) OVER (PARTITION BY symbol ORDER BY ret_index) AS before FROM cnt)"),
    "hysteresis_positions": labelled(
        "SELECT l.symbol, l.ts, l.ret_index, CAST(CASE WHEN l.ret_index >= 252 THEN h - 1 ELSE 0 END AS BIGINT) AS position FROM labels l LEFT JOIN fl ON fl.symbol = l.symbol AND fl.t = l.ret_index",
        "pst AS (SELECT symbol, ret_index, regime, [" + ", ".join(f"count(*) FILTER (regime = {k}) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) / 20" for k in range(3)) + "] AS p FROM labels)",
        """fl AS (
  SELECT symbol, 251 AS t, 1 AS h, 0 AS c, CAST(NULL AS DOUBLE[]) AS st FROM (SELECT DISTINCT symbol FROM labels)
  UNION ALL
  SELECT symbol, t, CASE WHEN turn THEN regime ELSE h END, CASE WHEN turn OR regime = h THEN 0 ELSE c + 1 END, CASE WHEN turn THEN p ELSE st END
  FROM (SELECT n.symbol, n.ret_index AS t, n.regime, h, c, st, n.p, n.regime <> h AND c + 1 >= 2 AND (st IS NULL OR n.p[n.regime + 1] - st[h + 1] > 0.12) AS turn FROM fl JOIN pst n ON n.symbol = fl.symbol AND n.ret_index = fl.t + 1))""", recursive=True),
    "replay": labelled("SELECT symbol, ts, ret_index, CAST(regime AS BIGINT) AS regime FROM labels WHERE ret_index >= 252"),
    "insufficient_history": labelled(LATE_SELECT, LATE),
    "filter_valid_results": labelled(f"SELECT * FROM ({LATE_SELECT}) WHERE sharpe IS NOT NULL", LATE),
    "validate_flat_results": query(BARS_SQL, RETS, ck.label_sql("labels", 20, 9.0), "cnt AS (SELECT symbol, count(*) FILTER (regime = 0) AS a, count(*) FILTER (regime = 1) AS b, count(*) FILTER (regime = 2) AS c, count(*) AS n FROM labels GROUP BY symbol)",
        select=" UNION ALL ".join([f"SELECT symbol, 'empty regime: {x}' AS problem FROM cnt WHERE {c} = 0" for c, x in zip("abc", rg.NAMES, strict=True)] + [f"SELECT symbol, 'dominant regime: {x}' FROM cnt WHERE {c} / n > 0.95" for c, x in zip("abc", rg.NAMES, strict=True)] + ["SELECT symbol, 'no trades' FROM cnt WHERE b = n"])),
    "clean_bars": """WITH raw AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, round(CAST(l_extendedprice AS DOUBLE), 2) AS p, CAST(l_quantity AS DOUBLE) AS v FROM lineitem WHERE CAST(l_quantity AS DOUBLE) > 25),
one AS (SELECT symbol, ts, arg_min(p, (p, v)) AS p, arg_min(v, (p, v)) AS v FROM raw GROUP BY symbol, ts)
SELECT symbol, ts, p AS open, p AS high, p AS low, p AS close, v AS volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_index FROM one""",
    "drop_incomplete": query(BARS_SQL, f"a AS (SELECT *, {ck.roll('avg', 'close', 200)} AS sma_200 FROM bars)", select=f"SELECT symbol, ts, {ck.near('sma_200', 6)} FROM a WHERE sma_200 IS NOT NULL"),
    "one_at_a_time": ck.swept("SELECT symbol, CAST(config_id AS BIGINT) AS config_id, " + ", ".join(r(c, 6) for c in METRIC_NAMES) + ', n_trades, "window", CAST(threshold AS DOUBLE) AS threshold, is_default FROM res WHERE "window" = 20 OR threshold = 0.05'),
    "runtime_summary": "SELECT event_type AS engine, round(avg(CAST(value AS DOUBLE)), 5) + 0.0 AS mean, round(median(CAST(value AS DOUBLE)), 5) + 0.0 AS median, round(min(CAST(value AS DOUBLE)), 5) + 0.0 AS least, round(max(CAST(value AS DOUBLE)), 5) + 0.0 AS most FROM events GROUP BY event_type",
    "feature_correlations": query(BARS_SQL, *corr_sql(), select=f"SELECT symbol, feature, rho FROM corrs"),
    "saliency_summary": query(BARS_SQL, *corr_sql(), select="SELECT symbol, round(avg(rho), 6) + 0.0 AS mean, round(median(rho), 6) + 0.0 AS median, round(max(rho), 6) + 0.0 AS most, count(*) FILTER (rho >= 0.02) AS selected FROM corrs GROUP BY symbol"),
    "saliency_selection": query(BARS_SQL, *corr_sql(), select="SELECT symbol, feature, round(rho, 6) + 0.0 AS rho FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rho DESC, feature) AS k FROM corrs) WHERE rho >= 0.03 OR k = 1"),
    "category_summary": query(BARS_SQL, *corr_sql(), AUDIT, select="SELECT category, round(avg(mean), 6) + 0.0 AS mean, round(stddev_pop(mean), 6) + 0.0 AS deviation, count(*) AS n FROM aud GROUP BY category"),
    "correlation_audit": query(BARS_SQL, *corr_sql(), AUDIT, select=f"SELECT feature, category, {r('mean', 6)}, {r('deviation', 6)}, {r('least', 6)}, {r('most', 6)}, n FROM aud"),
    "zscore_all_bars": query(BARS_SQL, f"a AS (SELECT *, ln(close / {ck.lag('close')}) AS lr FROM bars)", select="SELECT symbol, ts, CASE WHEN bar_index > 2 THEN round((lr - avg(lr) OVER w) / (stddev_pop(lr) OVER w + 1e-8), 4) + 0.0 END AS z_log_ret FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "evaluate": query(BARS_SQL, RETS, LABELS, ck.label_sql("other", 40, 0.08), DWELL3, ck.backtest_sql("dwelt", name="_a"), ck.backtest_sql("other", name="_b"), recursive=True,
        select=" UNION ALL ".join(f"SELECT m.symbol, '{e}' AS engine, c.regime, c.n_bear, c.n_sideways, c.n_bull, n_equity, " + ", ".join(r(c, 6) for c in METRIC_NAMES) + f", n_trades FROM met_{x} m JOIN (SELECT symbol, CAST(arg_max(regime, ret_index) AS BIGINT) AS regime, count(*) FILTER (regime = 0) AS n_bear, count(*) FILTER (regime = 1) AS n_sideways, count(*) FILTER (regime = 2) AS n_bull FROM {t} GROUP BY symbol) c ON c.symbol = m.symbol" for e, x, t in (("threshold", "a", "labels"), ("threshold_40", "b", "other")))),
    "assembled_record": labelled(
        "SELECT n.symbol AS source, 'threshold' AS engine, strftime(n.first_date, '%Y-%m-%d') AS start, strftime(n.last_date, '%Y-%m-%d') AS \"end\", ['bear', 'sideways', 'bull'][n.regime + 1] AS regime, CAST(n.regime AS BIGINT) AS regime_index, round(x.q2 - x.q0, 6) + 0.0 AS signal, "
        + ", ".join(f"round(w{j} / (w0 + w1 + w2), 6) + 0.0 AS pi_{c}, round(w.p{j}{j}, 6) + 0.0 AS stay_{c}, n.n_{c}" for j, c in enumerate(rg.NAMES)) + ", "
        + ", ".join(r(c, 6) for c in ("sharpe", "max_drawdown", "win_rate", "profit_factor", "total_return")) + ", n_trades, "
        + ", ".join(f"round(max(v{j}) FILTER (k = {k}) OVER (PARTITION BY n.symbol), 6) + 0.0 AS f{k}_{c}" for k in (1, 5, 20) for j, c in enumerate(rg.NAMES))
        + " FROM now n JOIN nexts x ON x.symbol = n.symbol JOIN weights g ON g.symbol = n.symbol JOIN wide w ON w.symbol = n.symbol JOIN met m ON m.symbol = n.symbol JOIN steps s ON s.symbol = n.symbol QUALIFY row_number() OVER (PARTITION BY n.symbol ORDER BY k) = 1",
        MATRIX, NOW, ck.FORECAST, ck.STATIONARY, ck.backtest_sql("labels"), recursive=True),
    "duration_forecast": labelled(
        f"SELECT symbol, regime, t AS days_in_regime, n, {r('shape', 4, 'weibull_shape')}, {r('scale', 4, 'weibull_scale')}, CASE WHEN t > 0 THEN round(shape / scale * pow(t / scale, shape - 1), 4) + 0.0 END AS hazard_rate, round(scale * pow(ln(2), 1 / shape), 4) + 0.0 AS survival_50pct, round({AREA}, 4) + 0.0 AS expected_remaining_days FROM life",
        SPELLS, WEIBULL, LIFE, recursive=True),
    "verdict": labelled(
        """SELECT symbol, CAST(regime AS BIGINT) AS regime, CASE WHEN regime = 2 THEN CASE WHEN fu > fb THEN 'bullish' ELSE 'transition_bear' END WHEN regime = 0 THEN CASE WHEN fb > fu THEN 'bearish' ELSE 'transition_bull' END
  WHEN abs(sg) < th THEN 'neutral' WHEN sg > 0 THEN 'transition_bull' ELSE 'transition_bear' END AS verdict, round(round(abs(sg), 4), 5) + 0.0 AS confidence, round(th, 5) + 0.0 AS threshold FROM vd""",
        MATRIX, NOW, ck.FORECAST, SPELLS, WEIBULL, LIFE,
        "vd AS (SELECT x.symbol, x.regime, x.q2 - x.q0 AS sg, s.v0 AS fb, s.v2 AS fu, CASE WHEN l.t / (l.scale * gamma(1 + 1 / l.shape)) > 1 THEN 0.1 * greatest(0.3, 2 - l.t / (l.scale * gamma(1 + 1 / l.shape))) ELSE 0.1 END AS th FROM nexts x JOIN steps s ON s.symbol = x.symbol AND s.k = 20 JOIN life l ON l.symbol = x.symbol)",
        recursive=True),
    "select_features": query(BARS_SQL, f"pl AS (SELECT {', '.join(f'{x} AS {n}' for n, x in ck.LEVELS.items())} FROM bars)", select=" UNION ALL ".join(f"SELECT '{n}' AS feature FROM pl HAVING count({n}) > 0" for n in ck.LEVELS)),
    "features_generic": joined(MADE, [("moving_averages", MOVING), ("channels", CHANNELS), ("price_levels", tuple(ck.LEVELS)), ("momentum", MOMENTUM), ("volume_features", (*VOLUME, "adl", "vpt", "eom_14", "volume_roc_10")), (TIMES_SQL, CALENDAR), ("ema", ("ema_20",)), ("atr_wilder", ("atr_14",)), ("rsi", ("rsi_14",)), ("adx_wilder", ADX_COLUMNS)], "b.*"),
    "model_scores": scored_sql(),
    "refit_moments": MOMENTS_SQL,
}
ORACLES["features_generic_ranges"] = ORACLES["features_generic"]
ORACLES["equity_ranges"] = ck.ORACLES["equity"]
