"""Queries over the index panel (and the event panel where ticks are needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import recurrences as rec
from tidemark.operators import backtest as bt
from tidemark.operators import diagnostics as diag
from tidemark.operators import evaluation as ev
from tidemark.operators import features as feat
from tidemark.operators import hmm
from tidemark.operators import regimes as rg
from tidemark.operators import survival as sv
from tidemark.sources import bars as src
from tidemark.tables import save

GRID = {"window": [10, 20, 40], "threshold": [0.02, 0.05, 0.08]}
DEFAULT = {"window": 20, "threshold": 0.05}
MIN_TRAIN = 252
#: Label and filter settings of the large sweep: 5 x 3 x 4 x 4.
FILTER_GRID = {"window": [10, 15, 20, 30, 40], "threshold": [0.02, 0.05, 0.08], "dwell": [0, 2, 3, 5], "lead": [0.0, 0.05, 0.12, 0.2]}
FILTER_DEFAULT = {"window": 20, "threshold": 0.05, "dwell": 0, "lead": 0.0}


#: Means of prices of 6 digits often lie just between two rounded values; so small a
#: part of the last digit added first makes both engines take the same one.
NUDGE = 3.1e-4


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0, **other: int) -> DataFrame:
    """Doubles rounded, counts as long: what the checks in SQL compare."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            n = other.get(name, digits)
            c = F.round(c + F.lit(nudge * 10**-n) if nudge else c, n) + F.lit(0.0)
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)


def panel(s: SparkSession, d: str) -> DataFrame:
    return src.index_panel(s, d)


def rets(s, d):
    return rg.returns(panel(s, d))


def labels(s, d):
    return rg.classify_threshold(rets(s, d))


def held(s, d, dwell=0):
    return bt.equity(bt.filtered_positions(labels(s, d), MIN_TRAIN, dwell), MIN_TRAIN)


def results(s, d):
    return ev.sweep_threshold(rets(s, d), ev.factorial_grid(s, GRID, DEFAULT), MIN_TRAIN)


def only(df: DataFrame, *drop: str) -> DataFrame:
    return df.drop("bar_index", "open", "high", "low", "close", "volume", *drop)


def nexts(s, d):
    return nexts_of(labels(s, d))


def nexts_of(lab: DataFrame) -> DataFrame:
    return rg.next_probabilities(rg.matrix_row(rg.transition_matrix(lab)), rg.current(lab))


def verdicts(s, d):
    lab = save(labels(s, d), "labels")  # worked out once for all that follows
    n = nexts_of(lab)
    far = rg.forecast(n).where("step = 20").select("symbol", "f_bear", "f_bull")
    life = sv.duration_forecast(rg.spells(lab)).select("symbol", "days_in_regime", "weibull_shape", "weibull_scale")
    stats = n.select("symbol", "regime").join(rg.signal(n), "symbol").join(far, "symbol").join(life, "symbol")
    return diag.verdict(stats.withColumn("threshold", F.coalesce(diag.dynamic_threshold(), F.lit(0.1)))).select("symbol", "regime", "verdict", "confidence", "threshold")


def validation(s, d):
    lab = labels(s, d)
    return diag.validate_results(rg.markov_stats(lab).join(bt.metrics(held(s, d)), "symbol"))


def bars_problems(s, d):
    p = panel(s, d)
    # Checked against a stricter minimum, so that short symbols show.
    return src.validate_bars(p, 2460)


def assembled(s, d):
    lab = save(labels(s, d), "labels")
    run = bt.equity(bt.positions(lab, MIN_TRAIN), MIN_TRAIN)
    return diag.assemble(rg.markov_stats(lab), bt.metrics(run), rg.forecast(nexts_of(lab)), "threshold")


def records(s, d):
    out = assembled(s, d)
    return out.select("source", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


#: The engines' features, log_ret first; engines not named here take the generic ones.
FEATURE_SETS = {"messina": (feat.curated, feat.CURATED)}


def hmm_inputs(s, d, engine="hmm"):
    make, names = FEATURE_SETS.get(engine, (feat.generic, feat.GENERIC))
    p = save(panel(s, d), "panel")  # read by the schedule, the features and the labels
    f = make(p).select("symbol", (F.col("bar_index") - 1).cast("int").alias("ret_index"), *names)
    return rg.returns(p), f.where("ret_index >= 0"), list(names)


def hmm_labels(s, d, engine="hmm"):
    r, f, columns = hmm_inputs(s, d, engine)
    config, every = hmm.engine_config(s, engine)
    return hmm.walk_forward_labels(r, f, columns, config, every, MIN_TRAIN)


def hmm_query(engine):
    def query(s, d):
        out, _ = hmm_labels(s, d, engine)
        return out.select("symbol", "ts", "ret_index", "regime", "p_bear", "p_sideways", "p_bull", "lookahead")

    return query


def last_refit(r: DataFrame) -> DataFrame:
    return r.groupBy("symbol").agg(F.max("ret_index").alias("refit")).where(F.col("refit") >= MIN_TRAIN)


#: 2 to min(6, max(2, n // 10)) states are tried; with MIN_TRAIN bars or more that is 6.
BIC_STATES, BIC_RESTARTS, AUDIT_RUNS = range(2, min(6, max(2, MIN_TRAIN // 10)) + 1), 3, 5


def bic(s, d):
    r, f, columns = hmm_inputs(s, d)
    configs = s.createDataFrame([(k, "hmm", k, 42 + 1000 * n + k, None, None) for k in BIC_STATES for n in range(BIC_RESTARTS)], "config_id int, engine string, n_states int, seed int, pca double, robust string")
    return hmm.select_states_bic(hmm.fit_models(hmm.training_slices(f, columns, last_refit(r)), configs))


def saliency(s, d):
    r, f, columns = hmm_inputs(s, d, "fshmm")
    configs = s.createDataFrame([(1, 3, 42 + n) for n in range(AUDIT_RUNS)], "config_id int, n_states int, seed int")
    return hmm.fit_saliencies(hmm.training_slices(f, columns, last_refit(r)), configs, columns)


def agreement(s, d):
    one = labels(s, d).select("symbol", F.lit("threshold_20").alias("engine"), "ret_index", "regime")
    two = rg.classify_threshold(rets(s, d), 40, 0.08).select("symbol", F.lit("threshold_40").alias("engine"), "ret_index", "regime")
    return ev.engine_agreement(one.unionByName(two))


def over_robust(s, d):
    return diag.over_robust_flag(rg.current(rg.classify_threshold(rets(s, d), 10)), rg.current(labels(s, d)))


def carried(s, d):
    """Refits' labels carried forward, with the threshold label standing for a fit."""
    lab = labels(s, d)
    fits = lab.join(hmm.refit_schedule(lab), ["symbol"]).where("ret_index = refit").select("symbol", "refit", "regime", *[F.lit(None).cast("double").alias(c) for c in ("p_bear", "p_sideways", "p_bull")])
    return hmm.carry_forward(rets(s, d), fits).select("symbol", "ts", "ret_index", "regime")


def backfilled(s, d):
    d2 = panel(s, d).withColumn("sma_20", ind.sma(20))
    return feat.backfill(d2, ["sma_20"]).select("symbol", "ts", "sma_20")


def zscores(s, d):
    d2 = panel(s, d).withColumn("log_ret", ind.log_return())
    return feat.zscore_expanding(d2, ["log_ret"]).where("bar_index >= 50").select("symbol", "ts", "z_log_ret")


def selected(s, d):
    p = panel(s, d)
    wide = ind.price_levels(p).withColumn("void", F.lit(None).cast("double"))
    return s.createDataFrame([(c,) for c in feat.select_features(wide)], "feature string")


def midstream(s, d):
    return hmm.midstream_collapse(labels(s, d)).groupBy("symbol").agg(F.count_if("collapsed").alias("collapsed_bars"), F.count("*").alias("bars"))


def remaining(s, d):
    done = results(s, d).where("config_id % 2 = 0")
    grid = rets(s, d).select("symbol").distinct().crossJoin(F.broadcast(ev.factorial_grid(s, GRID, DEFAULT)))
    return src.skip_done(grid, done, ["symbol", "config_id"])


def q(make, digits=6, nudge=0.0, **other):
    return lambda s, d: rounded(make(s, d), digits, nudge, **other)


QUERIES = {
    "index_panel": q(panel),
    "ticks_to_bars": q(src.event_panel),
    "validate_bars": bars_problems,
    "returns": q(lambda s, d: rets(s, d).select("symbol", "ts", "ret_index", "ret"), 8),
    "threshold_regimes": q(lambda s, d: labels(s, d).select("symbol", "ts", "ret_index", "regime")),
    "transition_matrix": q(lambda s, d: rg.transition_matrix(labels(s, d)), 8),
    "stationary": q(lambda s, d: rg.stationary(rg.matrix_row(rg.transition_matrix(labels(s, d)))), 8),
    "persistence": q(lambda s, d: rg.persistence(rg.matrix_row(rg.transition_matrix(labels(s, d)))), 8),
    "signal": q(lambda s, d: rg.signal(nexts(s, d)), 8),
    "forecast": q(lambda s, d: rg.forecast(nexts(s, d)), 8),
    "current_regime": q(lambda s, d: rg.current(labels(s, d))),
    "markov_stats": q(lambda s, d: rg.markov_stats(labels(s, d)), 8),
    "transitions": q(lambda s, d: rg.transitions(labels(s, d))),
    "latest_transitions": q(lambda s, d: rg.latest_transitions(rg.transitions(labels(s, d)), 5)),
    "spells": q(lambda s, d: rg.spells(labels(s, d))),
    "spell_covariates": q(lambda s, d: rg.spell_covariates(labels(s, d)), 8),
    "moving_averages": q(lambda s, d: only(ind.moving_averages(panel(s, d))), 6, NUDGE),
    "channels": q(lambda s, d: only(ind.channels(panel(s, d))), 5, NUDGE),
    "price_levels": q(lambda s, d: only(ind.price_levels(panel(s, d)))),
    "momentum": q(lambda s, d: only(ind.momentum(panel(s, d))), 5, NUDGE),
    "volume_features": q(lambda s, d: only(ind.volume_features(panel(s, d))), 5, adl=2, vpt=2, eom_14=6),
    "time_features": q(lambda s, d: ind.time_features(src.event_panel(s, d)).drop("bar_index", "open", "high", "low", "close", "volume"), 9),
    "ema": q(lambda s, d: only(rec.ema(panel(s, d), "ema_20", "close", 20)), 5),
    "atr_wilder": q(lambda s, d: only(rec.atr(rec.atr(panel(s, d), 14), 20)), 5),
    "rsi": q(lambda s, d: only(rec.rsi(panel(s, d))), 5),
    "adx_wilder": q(lambda s, d: only(rec.adx(panel(s, d))), 5),
    "kdj": q(lambda s, d: only(rec.kdj(panel(s, d))), 5),
    "macd": q(lambda s, d: only(rec.macd(panel(s, d))), 5),
    "keltner_chaikin": q(lambda s, d: only(rec.chaikin_volatility(rec.keltner(panel(s, d)))), 5),
    "vstop": q(lambda s, d: only(rec.vstop(panel(s, d))), 5, NUDGE, vstop_interaction=0),
    "features_curated": q(lambda s, d: only(feat.curated(panel(s, d))), 5),
    "features_generic": q(lambda s, d: feat.generic(panel(s, d)), 4),
    "positions": q(lambda s, d: bt.positions(labels(s, d)).select("symbol", "ts", "ret_index", "position")),
    "filtered_positions": q(lambda s, d: bt.filtered_positions(labels(s, d), MIN_TRAIN, 3).select("symbol", "ts", "ret_index", "position")),
    "equity": q(lambda s, d: held(s, d).select("symbol", "ts", "ret_index", "pnl", "equity"), 8),
    "trades": q(lambda s, d: bt.trades(held(s, d)), 7),
    # As its SQL, only runs that were below a peak; the operator has the others with zeros.
    "drawdown": q(lambda s, d: bt.drawdown(held(s, d)).where("max_duration > 0"), 7),
    "ann_factor": q(lambda s, d: bt.ann_factor(rets(s, d))),
    "backtest": q(lambda s, d: bt.metrics(held(s, d)), 6),
    "weibull_fit": q(lambda s, d: sv.weibull_fit(rg.spells(labels(s, d))), 5),
    "duration_forecast": q(lambda s, d: sv.duration_forecast(rg.spells(labels(s, d))), 4),
    "cox_fit": q(lambda s, d: sv.cox_fit(rg.spell_covariates(labels(s, d))), 4),
    "verdict": q(verdicts, 5),
    "collapse_flag": q(lambda s, d: diag.collapse_flag(rg.current(labels(s, d)), 3, 0.25).select("symbol", "degenerate", "caveat")),
    "low_data_flag": q(lambda s, d: diag.low_data_flag(rg.current(labels(s, d)), 49, 3).select("symbol", "n_bars", "low_data")),
    "over_robust_flag": q(over_robust),
    "validate_results": validation,
    "assemble_result": records,
    "sweep_grid": q(results, 6),
    "sweep_filters": q(lambda s, d: ev.sweep_filters(rets(s, d), ev.factorial_grid(s, FILTER_GRID, FILTER_DEFAULT), MIN_TRAIN), 6),
    "best_config": q(lambda s, d: ev.best_configs(results(s, d)), 6),
    "extremes": q(lambda s, d: ev.extremes(results(s, d)), 6),
    "composite_score": q(lambda s, d: ev.composite_score(results(s, d)), 5),
    "win_counts": q(lambda s, d: ev.win_counts(results(s, d), "window")),
    "top3_frequency": q(lambda s, d: ev.top_frequency(results(s, d), ["window"])),
    "rank_configs": q(lambda s, d: ev.rank_configs(results(s, d)), 6),
    "parameter_impact": q(lambda s, d: ev.parameter_impact(results(s, d), ["window"]), 6),
    "versus_default": q(lambda s, d: ev.versus_default(results(s, d)), 6),
    "improved_counts": q(lambda s, d: ev.improved_counts(ev.versus_default(results(s, d)))),
    "default_vs_best": q(lambda s, d: ev.default_vs_best(results(s, d)), 6),
    "engine_agreement": q(agreement),
    "skip_done": q(remaining),
    "refit_schedule": q(lambda s, d: hmm.refit_schedule(rets(s, d))),
    "carry_forward": q(carried),
    "backfill": q(backfilled, 6, NUDGE),
    "zscore_expanding": q(zscores, 5),
    "select_features": selected,
    "midstream_collapse": q(midstream),
    "hmm_labels": hmm_query("hmm"),
    "messina_labels": hmm_query("messina"),
    "robust_hmm_labels": hmm_query("robust_hmm"),
    "fshmm_labels": hmm_query("fshmm"),
    "select_states_bic": bic,
    "saliency_audit": lambda s, d: ev.saliency_audit(saliency(s, d)),
    "pooled_pca": lambda s, d: feat.pooled_pca(ind.price_levels(panel(s, d)), [f"{k}_{n}" for k in ("price_position", "hl_ratio") for n in (5, 10, 20)]),
}
