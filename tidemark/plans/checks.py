"""The queries in plain SQL, over the same tables."""

from __future__ import annotations

import math

from tidemark.sources.bars import BARS_SQL

W = "(PARTITION BY symbol ORDER BY ts)"
RETS = """rets AS (SELECT symbol, ts, bar_index - 1 AS ret_index, close, ret FROM (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) WHERE bar_index > 0)"""


def label_sql(name: str = "labels", window: int = 20, threshold: float = 0.05) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {window - 1} PRECEDING)"
    return f"""{name} AS (SELECT *, CASE WHEN ret_index >= {window - 1} AND tot > {threshold} THEN 2 WHEN ret_index >= {window - 1} AND tot < -{threshold} THEN 0 ELSE 1 END AS regime
  FROM (SELECT *, round(sum(ret) {f}, 10) AS tot FROM rets))"""


LABELS = label_sql()
MATRIX = """pairs AS (SELECT symbol, regime AS f, lead(regime) OVER (PARTITION BY symbol ORDER BY ts) AS t FROM labels),
cells AS (
  SELECT s.symbol, i AS from_regime, j AS to_regime, count(p.f) AS n
  FROM (SELECT DISTINCT symbol FROM labels) s CROSS JOIN range(3) AS a(i) CROSS JOIN range(3) AS b(j) LEFT JOIN pairs p ON p.symbol = s.symbol AND p.f = i AND p.t = j GROUP BY ALL),
shared AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY symbol, from_regime), 0), 0) + 1e-10 AS q FROM cells),
tm AS (SELECT symbol, from_regime, to_regime, n, q / sum(q) OVER (PARTITION BY symbol, from_regime) AS p FROM shared),
wide AS (SELECT symbol, """ + ", ".join(f"max(p) FILTER (from_regime = {i} AND to_regime = {j}) AS p{i}{j}" for i in range(3) for j in range(3)) + """ FROM tm GROUP BY symbol)"""
NOW = """now AS (SELECT symbol, arg_max(regime, ret_index) AS regime, min(ts) AS first_date, max(ts) AS last_date,
  count(*) FILTER (regime = 0) AS n_bear, count(*) FILTER (regime = 1) AS n_sideways, count(*) FILTER (regime = 2) AS n_bull FROM labels GROUP BY symbol),
nexts AS (SELECT wide.*, regime, """ + ", ".join(f"CASE regime WHEN 0 THEN p0{j} WHEN 1 THEN p1{j} ELSE p2{j} END AS q{j}" for j in range(3)) + """ FROM wide JOIN now USING (symbol))"""
FORECAST = """steps AS (
  SELECT symbol, 0 AS k, q0 AS v0, q1 AS v1, q2 AS v2 FROM nexts
  UNION ALL
  SELECT s.symbol, k + 1, """ + ", ".join(f"v0 * p0{j} + v1 * p1{j} + v2 * p2{j}" for j in range(3)) + """ FROM steps s JOIN wide w ON s.symbol = w.symbol WHERE k < 20)"""
STATIONARY = """weights AS (SELECT symbol, p10 * p20 + p12 * p20 + p21 * p10 AS w0, p01 * p21 + p02 * p21 + p20 * p01 AS w1, p02 * p12 + p01 * p12 + p10 * p02 AS w2 FROM wide)"""
SPELLS = """marked AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS spell FROM (
  SELECT *, CASE WHEN regime <> lag(regime) OVER (PARTITION BY symbol ORDER BY ts) THEN 1 ELSE 0 END AS new FROM labels)),
runs AS (SELECT *, spell = max(spell) OVER (PARTITION BY symbol) AS censored FROM (
  SELECT symbol, spell, min(regime) AS regime, min(ret_index) AS start_index, max(ret_index) AS end_index, count(*) AS duration FROM marked GROUP BY symbol, spell))"""


def backtest_sql(source: str, keys: str = "symbol", name: str = "") -> str:
    w = f"PARTITION BY {keys} ORDER BY ret_index"
    return f"""pos{name} AS (SELECT *, CASE WHEN ret_index >= 252 THEN regime - 1 ELSE 0 END AS position FROM {source}),
pnl{name} AS (SELECT *, coalesce(lag(position) OVER ({w}) * ret, 0.0) AS pnl FROM pos{name}),
eq{name} AS (SELECT *, CASE WHEN ret_index >= 252 THEN exp(sum(ln(1 + pnl)) OVER ({w})) END AS equity FROM pnl{name}),
tr{name} AS (SELECT *, sum(CASE WHEN position <> 0 AND prev = 0 THEN 1 ELSE 0 END) OVER ({w}) AS trade FROM (SELECT *, lag(position) OVER ({w}) AS prev FROM eq{name})),
trades{name} AS (SELECT {keys}, trade, min(ret_index) AS entry_index, max(ret_index) AS exit_index, arg_max(equity, ret_index) / arg_min(equity, ret_index) - 1 AS profit
  FROM tr{name} WHERE trade > 0 AND (position <> 0 OR prev <> 0) GROUP BY {keys}, trade),
dd{name} AS (SELECT *, equity / peak - 1 AS dd, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER ({w}) AS episode, lead(equity >= peak) OVER ({w}) AS ends
  FROM (SELECT *, max(equity) OVER ({w}) AS peak FROM eq{name} WHERE equity IS NOT NULL)),
ep{name} AS (SELECT {keys}, episode, count(*) AS bars, min(dd) AS deepest, sum(dd) AS total, bool_or(ends) AS ended FROM dd{name} WHERE equity < peak GROUP BY {keys}, episode),
ddm{name} AS (SELECT {keys}, min(deepest) AS max_drawdown, sum(total) / sum(bars) AS avg_drawdown, max(bars) AS max_duration, avg(bars) FILTER (ended) AS avg_recovery FROM ep{name} GROUP BY {keys}),
st{name} AS (SELECT *, coalesce(equity / lag(equity) OVER ({w}) - 1, 0) AS step, epoch_us(ts) - lag(epoch_us(ts)) OVER ({w}) AS gap FROM eq{name} WHERE equity IS NOT NULL),
sums{name} AS (SELECT {keys}, count(*) AS n_equity, arg_max(equity, ret_index) / arg_min(equity, ret_index) - 1 AS total_return, avg(step) AS mean, stddev_samp(step) AS sd,
  CASE WHEN median(gap) <= 3600e6 THEN 8760 WHEN median(gap) <= 86400e6 THEN 252 WHEN median(gap) <= 7 * 86400e6 THEN 52 WHEN median(gap) <= 31 * 86400e6 THEN 12 ELSE 4 END AS ann FROM st{name} GROUP BY {keys}),
made{name} AS (SELECT {keys}, count(*) AS n_trades, avg(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(profit) FILTER (profit > 0) AS won, -sum(profit) FILTER (profit < 0) AS lost FROM trades{name} GROUP BY {keys}),
met{name} AS (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE sqrt(ann) * (mean - 0.02 / ann) / sd END AS sharpe, CASE WHEN lost IS NOT NULL THEN coalesce(won, 0) / lost END AS profit_factor
  FROM sums{name} LEFT JOIN ddm{name} USING ({keys}) LEFT JOIN made{name} USING ({keys}))"""


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + select


def panel(select: str) -> str:
    return query(BARS_SQL, select=select)


def labelled(select: str, *ctes: str, recursive: bool = False) -> str:
    return query(BARS_SQL, RETS, LABELS, *ctes, select=select, recursive=recursive)


def r(x: str, digits: int, name: str | None = None) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def near(x: str, digits: int, name: str | None = None) -> str:
    """As ``r``, with the queries' nudge."""
    return f"round({x} + {3.1e-4 * 10**-digits!r}, {digits}) + 0.0 AS {name or x}"


def roll(agg: str, x: str, n: int, mp: int | None = None) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {f} >= {n if mp is None else mp} THEN {agg}({x}) {f} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def wma(x: str, n: int) -> str:
    return "(" + " + ".join([f"{lag(x, n - k)} * {k}" for k in range(1, n)] + [f"{x} * {n}"]) + f") / {n * (n + 1) / 2}"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
KEYS = "symbol, ts"


def recurrence(name: str, source: str, u: str, a: float) -> str:
    """CTEs: y(t) = a y(t-1) + u over the rows of ``source`` where u isn't null."""
    return f"""{name}_u AS (SELECT symbol, ts, u, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM (SELECT symbol, ts, {u} AS u FROM {source}) WHERE u IS NOT NULL),
{name} AS (SELECT symbol, ts, k, u AS y FROM {name}_u WHERE k = 1 UNION ALL SELECT n.symbol, n.ts, n.k, {a!r} * p.y + n.u FROM {name} p JOIN {name}_u n ON n.symbol = p.symbol AND n.k = p.k + 1)"""


def ema(name: str, source: str, x: str, n: int, alpha: float | None = None) -> str:
    alpha = alpha or 2 / (n + 1)
    return recurrence(name, f"(SELECT *, count({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM {source})", f"CASE WHEN {x} IS NULL THEN NULL WHEN nth = 1 THEN {x} ELSE {alpha!r} * {x} END", 1 - alpha)


def wilder(name: str, source: str, x: str, n: int) -> str:
    return recurrence(name, f"(SELECT *, row_number() OVER {W} AS pos, avg({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seed FROM {source})", f"CASE WHEN pos = {n} THEN seed WHEN pos > {n} THEN {x} / {n}.0 END", 1 - 1 / n)


ADJUSTED = lambda name, source, x, span: recurrence(name, source, x, 1 - 2 / (span + 1))


def adjusted_value(name: str, span: int) -> str:
    a = 1 - 2 / (span + 1)
    return f"{name}.y * {1 - a!r} / (1 - pow({a!r}, {name}.k))"


TRB = f"trb AS (SELECT *, {TR} AS tr FROM bars)"
DM = f"""dmb AS (SELECT *, {TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS down FROM bars),
dm AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS dmp, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS dmn FROM dmb)"""
ADX = ",\n".join([DM, wilder("wt", "dm", "tr", 14), wilder("wp", "dm", "dmp", 14), wilder("wn", "dm", "dmn", 14), """di AS (SELECT b.symbol, b.ts, CASE WHEN wt.y = 0 THEN 0 ELSE 100 * wp.y / wt.y END AS dip, CASE WHEN wt.y = 0 THEN 0 ELSE 100 * wn.y / wt.y END AS din
  FROM bars b LEFT JOIN wt ON b.symbol = wt.symbol AND b.ts = wt.ts LEFT JOIN wp ON b.symbol = wp.symbol AND b.ts = wp.ts LEFT JOIN wn ON b.symbol = wn.symbol AND b.ts = wn.ts),
dxs AS (SELECT *, CASE WHEN dip + din = 0 THEN 0 ELSE 100 * abs(dip - din) / (dip + din) END AS dx FROM di)""", wilder("wa", "dxs", "dx", 14)])  # fmt: skip

LEVELS = {f"{k}_{n}": (div(f"close - {roll('min', 'low', n, min(10, n))}", f"({roll('max', 'high', n, min(10, n))}) - ({roll('min', 'low', n, min(10, n))})") if k == "price_position" else div(roll("max", "high", n, min(10, n)), roll("min", "low", n, min(10, n)))) for k in ("price_position", "hl_ratio") for n in (5, 10, 20)}
HH, LL = roll("max", "high", 14), roll("min", "low", 14)
SWEEP = ["grid AS (SELECT *, CAST(row_number() OVER (ORDER BY \"window\", threshold) AS INTEGER) AS config_id, \"window\" = 20 AND threshold = 0.05 AS is_default FROM (VALUES (10), (20), (40)) AS a(\"window\") CROSS JOIN (VALUES (0.02), (0.05), (0.08)) AS b(threshold))"]
SWEEP += [f"s{n} AS (SELECT *, round(sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING), 10) AS tot, {n} AS w FROM rets)" for n in (10, 20, 40)]
SWEEP += ["swept AS (SELECT s.symbol, s.ts, s.ret_index, s.ret, g.config_id, CASE WHEN ret_index >= w - 1 AND tot > threshold THEN 2 WHEN ret_index >= w - 1 AND tot < -threshold THEN 0 ELSE 1 END AS regime FROM (SELECT * FROM s10 UNION ALL SELECT * FROM s20 UNION ALL SELECT * FROM s40) s JOIN grid g ON g.\"window\" = s.w)", backtest_sql("swept", "symbol, config_id", "2")]
SWEEP += ["res AS (SELECT symbol, config_id, total_return, sharpe, coalesce(max_drawdown, 0) AS max_drawdown, coalesce(n_trades, 0) AS n_trades, win_rate, profit_factor, \"window\", threshold, is_default FROM met2 JOIN grid USING (config_id))"]
METRICS = ("sharpe", "total_return", "win_rate", "profit_factor", "max_drawdown")
BEST = "best AS (" + " UNION ALL ".join(f"SELECT symbol, '{m}' AS metric, config_id, {m} AS value FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {m} DESC, config_id) AS k FROM res WHERE {m} IS NOT NULL) WHERE k = 1" for m in METRICS) + ")"


def swept(select: str, *ctes: str) -> str:
    return query(BARS_SQL, RETS, *SWEEP, *ctes, select=select)


def z(m: str) -> str:
    return f"coalesce(({m} - avg({m}) OVER (PARTITION BY symbol)) / nullif(stddev_samp({m}) OVER (PARTITION BY symbol), 0), 0)"


EVENTS = """ev AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2)"""
TAU = repr(2 * math.pi)
WEIBULL = """ds AS (SELECT symbol, regime, list(CAST(duration AS DOUBLE)) AS d FROM runs WHERE NOT censored GROUP BY symbol, regime),
wb AS (SELECT *, len(d) AS n, list_max(d) AS top, list_avg([ln(x / list_max(d)) FOR x IN d]) AS mean_log FROM ds),
bis AS (
  SELECT symbol, regime, 0 AS k, ln(1e-3) AS lo, ln(1e3) AS hi FROM wb WHERE n >= 3 AND list_min(d) < top
  UNION ALL
  SELECT symbol, regime, k + 1, CASE WHEN slope > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN slope > 0 THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT b.*, list_sum([pow(x / w.top, exp((lo + hi) / 2)) * ln(x / w.top) FOR x IN w.d]) / list_sum([pow(x / w.top, exp((lo + hi) / 2)) FOR x IN w.d]) - 1 / exp((lo + hi) / 2) - w.mean_log AS slope
        FROM bis b JOIN wb w ON w.symbol = b.symbol AND w.regime = b.regime WHERE k < 60)),
shapes AS (SELECT wb.*, CASE WHEN wb.n < 3 THEN NULL WHEN list_min(d) = top THEN 1.0 ELSE exp((lo + hi) / 2) END AS shape FROM wb LEFT JOIN bis ON bis.symbol = wb.symbol AND bis.regime = wb.regime AND bis.k = 60),
fits AS (SELECT symbol, regime, n, shape, CASE WHEN n >= 3 AND list_min(d) = top THEN top ELSE top * pow(list_sum([pow(x / top, shape) FOR x IN d]) / n, 1 / shape) END AS scale FROM shapes)"""
STATS_COLUMNS = "now.symbol, now.regime, first_date, last_date, n_bear, n_sideways, n_bull, round(q2 - q0, 8) + 0.0 AS signal, round(w0 / (w0 + w1 + w2), 8) + 0.0 AS pi_bear, round(w1 / (w0 + w1 + w2), 8) + 0.0 AS pi_sideways, round(w2 / (w0 + w1 + w2), 8) + 0.0 AS pi_bull, round(wide.p00, 8) + 0.0 AS stay_bear, round(wide.p11, 8) + 0.0 AS stay_sideways, round(wide.p22, 8) + 0.0 AS stay_bull"

ORACLES = {
    "index_panel": panel("SELECT symbol, ts, CAST(bar_index AS BIGINT) AS bar_index, open, high, low, close, volume FROM bars"),
    "ticks_to_bars": query(EVENTS, select=f"SELECT symbol, ts, row_number() OVER {W} - 1 AS bar_index, {r('open', 6)}, {r('high', 6)}, {r('low', 6)}, {r('close', 6)}, volume FROM ev"),
    "validate_bars": panel("SELECT symbol, 'fewer than 2460 rows' AS problem FROM bars GROUP BY symbol HAVING count(*) < 2460 UNION ALL SELECT symbol, 'high below low' FROM bars WHERE high < low GROUP BY symbol"),
    "returns": query(BARS_SQL, RETS, select=f"SELECT symbol, ts, CAST(ret_index AS BIGINT) AS ret_index, {r('ret', 8)} FROM rets"),
    "threshold_regimes": labelled("SELECT symbol, ts, CAST(ret_index AS BIGINT) AS ret_index, CAST(regime AS BIGINT) AS regime FROM labels"),
    "transition_matrix": labelled(f"SELECT symbol, from_regime, to_regime, n, {r('p', 8)} FROM tm", MATRIX),
    "stationary": labelled("SELECT symbol, round(w0 / (w0 + w1 + w2), 8) + 0.0 AS pi_bear, round(w1 / (w0 + w1 + w2), 8) + 0.0 AS pi_sideways, round(w2 / (w0 + w1 + w2), 8) + 0.0 AS pi_bull FROM weights", MATRIX, STATIONARY),
    "persistence": labelled("SELECT symbol, round(p00, 8) + 0.0 AS stay_bear, round(p11, 8) + 0.0 AS stay_sideways, round(p22, 8) + 0.0 AS stay_bull FROM wide", MATRIX),
    "signal": labelled("SELECT symbol, round(q2 - q0, 8) + 0.0 AS signal FROM nexts", MATRIX, NOW),
    "forecast": labelled("SELECT symbol, CAST(k AS BIGINT) AS step, round(v0, 8) + 0.0 AS f_bear, round(v1, 8) + 0.0 AS f_sideways, round(v2, 8) + 0.0 AS f_bull FROM steps WHERE k IN (1, 5, 20)", MATRIX, NOW, FORECAST, recursive=True),
    "current_regime": labelled("SELECT symbol, CAST(regime AS BIGINT) AS regime, first_date, last_date, n_bear, n_sideways, n_bull FROM now", MATRIX, NOW),
    "markov_stats": labelled(f"SELECT {STATS_COLUMNS} FROM now JOIN nexts ON nexts.symbol = now.symbol JOIN weights ON weights.symbol = now.symbol JOIN wide ON wide.symbol = now.symbol", MATRIX, NOW, STATIONARY),
    "transitions": labelled("SELECT symbol, ts, strftime(ts, '%Y-%m-%d') AS date, ret_index, f AS from_regime, regime AS to_regime FROM (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY ts) AS f FROM labels) WHERE f <> regime"),
    "latest_transitions": labelled("SELECT * FROM (SELECT symbol, ts, strftime(ts, '%Y-%m-%d') AS date, ret_index, f AS from_regime, regime AS to_regime, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rank FROM (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY ts) AS f FROM labels) WHERE f <> regime) WHERE rank <= 5"),
    "spells": labelled("SELECT symbol, CAST(spell AS BIGINT) AS spell, regime, start_index, end_index, duration, censored FROM runs", SPELLS),
    "spell_covariates": labelled("SELECT m.symbol, CAST(m.spell AS BIGINT) AS spell, any_value(r.regime) AS regime, any_value(r.duration) AS duration, NOT any_value(r.censored) AS event, round(stddev_pop(ln(1 + ret)), 8) + 0.0 AS volatility, round(sum(ln(1 + ret)), 8) + 0.0 AS total_log_return FROM marked m JOIN runs r ON r.symbol = m.symbol AND r.spell = m.spell GROUP BY m.symbol, m.spell", SPELLS),
    "moving_averages": query(BARS_SQL, f"a AS (SELECT *, {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 13)} AS sma_13, {roll('avg', 'close', 200)} AS sma_200, ({roll('avg', 'close', 50)}) / ({roll('avg', 'close', 200)}) AS sma_ratio_50_200, {roll('avg', 'close', 10, 10)} AS half, {wma('close', 10)} AS wma_10, 2 * {wma('close', 8)} - {wma('close', 16)} AS hull FROM bars)",
        f"b AS (SELECT *, {roll('avg', 'half', 10, 10)} AS tma_20, {wma('hull', 4)} AS hma_16 FROM a)", select="SELECT symbol, ts, " + ", ".join(near(c, 6) for c in ("sma_20", "sma_13", "sma_200", "sma_ratio_50_200", "wma_10", "tma_20", "hma_16")) + " FROM b"),
    "channels": query(BARS_SQL, f"a AS (SELECT *, {TR} AS true_range, ln(close / {lag('close')}) AS lr, {roll('avg', 'close', 20)} AS bb_middle, {roll('stddev_pop', 'close', 20)} AS sd FROM bars)",
        f"b AS (SELECT *, true_range / close AS true_range_pct, {roll('avg', 'true_range', 14, 10)} AS atr_sma_14, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower, {roll('max', 'high', 20, 10)} AS donchian_upper, {roll('min', 'low', 20, 10)} AS donchian_lower, ({roll('stddev_samp', 'lr', 20, 10)}) * sqrt(252) AS hist_vol FROM a)",
        "c AS (SELECT *, (bb_upper - bb_lower) / bb_middle * 100 AS bb_width, (donchian_upper + donchian_lower) / 2 AS donchian_middle FROM b)",
        select="SELECT symbol, ts, " + ", ".join(near(c, 5) for c in ("true_range", "bb_middle", "true_range_pct", "atr_sma_14", "bb_upper", "bb_lower", "bb_width", "donchian_upper", "donchian_lower", "hist_vol", "donchian_middle")) + f", {near('(close - bb_lower) / nullif(bb_width, 0)', 5, 'bb_position')} FROM c"),
    "price_levels": panel("SELECT symbol, ts, " + ", ".join(r(x, 6, n) for n, x in LEVELS.items()) + " FROM bars"),
    "momentum": query(BARS_SQL, f"a AS (SELECT *, (high + low + close) / 3 AS tp, {TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS down, ({HH}) AS hh, ({LL}) AS ll FROM bars)",
        f"""b AS (SELECT *, CASE WHEN up > down THEN greatest(up, 0.0) ELSE 0.0 END AS dmp, CASE WHEN down > up THEN greatest(down, 0.0) ELSE 0.0 END AS dmn, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0.0 END AS inn, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0.0 END AS outt, {div('close - ll', 'hh - ll')} * 100 AS stoch_k_14, {div('hh - close', 'hh - ll')} * -100 AS williams_r_14,
          {roll('avg', 'tp', 20, 10)} AS m20, list(tp) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS tps, list(high) OVER (PARTITION BY symbol ORDER BY ts ROWS 24 PRECEDING) AS hs, list(low) OVER (PARTITION BY symbol ORDER BY ts ROWS 24 PRECEDING) AS ls FROM a)""",
        f"""c AS (SELECT *, {roll('avg', 'stoch_k_14', 3)} AS stoch_d_3, (tp - m20) / nullif(0.015 * list_avg([abs(x - m20) FOR x IN tps]), 0) AS cci_20, {div(roll('sum', 'inn', 14, 10), roll('sum', 'outt', 14, 10))} AS flow, CASE WHEN len(hs) >= 10 THEN (24.0 - (list_position(hs, list_max(hs)) - 1)) / 24.0 * 100 END AS aroon_up_25, CASE WHEN len(ls) >= 10 THEN (24.0 - (list_position(ls, list_min(ls)) - 1)) / 24.0 * 100 END AS aroon_down_25,
          {div(roll('avg', 'dmp', 14, 10), roll('avg', 'tr', 14, 10))} * 100 AS dmi_plus_14, {div(roll('avg', 'dmn', 14, 10), roll('avg', 'tr', 14, 10))} * 100 AS dmi_minus_14, (close - {lag('close', 10)}) / {lag('close', 10)} * 100 AS roc_10, close - {lag('close', 10)} AS mtm_10, (close - {lag('close', 12)}) / {lag('close', 12)} * 100 AS proc_12 FROM b)""",
        f"d AS (SELECT *, abs(dmi_plus_14 - dmi_minus_14) / nullif(dmi_plus_14 + dmi_minus_14, 0) * 100 AS dx, 100 - 100 / nullif(1 + flow, 0) AS mfi_14, aroon_up_25 - aroon_down_25 AS aroon_oscillator_25 FROM c)", f"e AS (SELECT *, {roll('avg', 'dx', 14, 10)} AS dmi_adx_14 FROM d)",
        select="SELECT symbol, ts, " + ", ".join(near(c, 5) for c in ("roc_10", "mtm_10", "proc_12", "stoch_k_14", "williams_r_14", "stoch_d_3", "cci_20", "mfi_14", "aroon_up_25", "aroon_down_25", "dmi_plus_14", "dmi_minus_14", "aroon_oscillator_25", "dmi_adx_14")) + " FROM e"),
    "volume_features": query(BARS_SQL, f"a AS (SELECT *, {roll('avg', 'volume', 20, 10)} AS volume_sma_20, (high + low + close) / 3 AS tp, close - {lag('close')} AS st, {lag('close')} AS pc, coalesce({div('2 * close - low - high', 'high - low')}, 0) * volume AS mfv, (high + low) / 2 AS mid FROM bars)", f"b AS (SELECT *, (mid - {lag('mid')}) / nullif(high - low, 0) AS em, sign(st) * volume AS sg, st / pc * volume AS rv FROM a)",
        select=f"SELECT symbol, ts, {r('volume_sma_20', 5)}, {r('volume / nullif(volume_sma_20, 0)', 5, 'volume_ratio_20')}, round(sum(sg) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS obv, round(sum(tp * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS vwap, round(sum(mfv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS adl, round(sum(rv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS vpt, {r(roll('avg', 'em', 14, 10), 6, 'eom_14')}, round((volume - {lag('volume', 10)}) / nullif({lag('volume', 10)}, 0) * 100, 5) + 0.0 AS volume_roc_10 FROM b"),
    "time_features": query(EVENTS, select=f"""SELECT symbol, ts, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month, quarter(ts) AS quarter, CAST(last_day(ts) = CAST(ts AS DATE) AS BIGINT) AS is_month_end, CAST(day(ts) = 1 AS BIGINT) AS is_month_start, CAST(last_day(ts) = CAST(ts AS DATE) AND month(ts) % 3 = 0 AS BIGINT) AS is_quarter_end,
        round(sin({TAU} * (isodow(ts) - 1) / 7), 9) + 0.0 AS day_of_week_sin, round(cos({TAU} * (isodow(ts) - 1) / 7), 9) + 0.0 AS day_of_week_cos, round(sin({TAU} * month(ts) / 12), 9) + 0.0 AS month_sin, round(cos({TAU} * month(ts) / 12), 9) + 0.0 AS month_cos, hour(ts) AS hour, minute(ts) AS minute, CAST(CASE WHEN hour(ts) < 8 THEN 0 WHEN hour(ts) < 16 THEN 1 ELSE 2 END AS BIGINT) AS session,
        round(sin({TAU} * hour(ts) / 24), 9) + 0.0 AS hour_sin, round(cos({TAU} * hour(ts) / 24), 9) + 0.0 AS hour_cos, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM ev"""),
    "ema": query(BARS_SQL, ema("e", "bars", "close", 20), select=f"SELECT symbol, ts, CASE WHEN k >= 20 THEN round(y, 5) END AS ema_20 FROM e", recursive=True),
    "atr_wilder": query(BARS_SQL, TRB, wilder("w1", "trb", "tr", 14), wilder("w2", "trb", "tr", 20), select="SELECT b.symbol, b.ts, round(w1.y, 5) AS atr_14, round(w2.y, 5) AS atr_20 FROM bars b LEFT JOIN w1 ON b.symbol = w1.symbol AND b.ts = w1.ts LEFT JOIN w2 ON b.symbol = w2.symbol AND b.ts = w2.ts", recursive=True),
    "rsi": query(BARS_SQL, f"st AS (SELECT *, greatest(coalesce(close - {lag('close')}, 0), 0.0) AS rise, greatest(coalesce({lag('close')} - close, 0), 0.0) AS fall FROM bars)", ema("e1", "st", "rise", 14, 1 / 14), ema("e2", "st", "fall", 14, 1 / 14), select="SELECT e1.symbol, e1.ts, CASE WHEN e1.k < 14 THEN NULL WHEN e2.y = 0 THEN 100.0 ELSE round(100 - 100 / (1 + e1.y / e2.y), 5) END AS rsi_14 FROM e1 JOIN e2 ON e1.symbol = e2.symbol AND e1.ts = e2.ts", recursive=True),
    "adx_wilder": query(BARS_SQL, ADX, select="SELECT symbol, ts, round(dip, 5) + 0.0 AS di_plus_14, round(din, 5) + 0.0 AS di_minus_14, round(dip - din, 5) + 0.0 AS di_spread, round(a, 5) + 0.0 AS adx_14, round(a - lag(a) OVER (PARTITION BY symbol ORDER BY ts), 5) + 0.0 AS adx_inflection FROM (SELECT d.*, wa.y AS a FROM dxs d LEFT JOIN wa ON d.symbol = wa.symbol AND d.ts = wa.ts)", recursive=True),
    "kdj": query(BARS_SQL, f"rs AS (SELECT *, {div('close - (' + roll('min', 'low', 9) + ')', '(' + roll('max', 'high', 9) + ') - (' + roll('min', 'low', 9) + ')')} * 100 AS rsv FROM bars)", ema("kk", "rs", "rsv", 1, 1 / 3), "kb AS (SELECT symbol, ts, y FROM kk)", ema("jd", "kb", "y", 1, 1 / 3), select="SELECT b.symbol, b.ts, round(3 * kk.y - 2 * jd.y, 5) + 0.0 AS kdj_j FROM bars b LEFT JOIN kk ON b.symbol = kk.symbol AND b.ts = kk.ts LEFT JOIN jd ON b.symbol = jd.symbol AND b.ts = jd.ts", recursive=True),
    "macd": query(BARS_SQL, ema("f1", "bars", "close", 12), ema("s1", "bars", "close", 26), "md AS (SELECT f1.symbol, f1.ts, CASE WHEN s1.k >= 26 THEN f1.y - s1.y END AS m FROM f1 JOIN s1 ON f1.symbol = s1.symbol AND f1.ts = s1.ts)", ema("sg", "md", "m", 9), select="SELECT md.symbol, md.ts, round(m, 5) + 0.0 AS macd, CASE WHEN sg.k >= 9 THEN round(sg.y, 5) + 0.0 END AS macd_signal, CASE WHEN sg.k >= 9 THEN round(m - sg.y, 5) + 0.0 END AS macd_hist FROM md LEFT JOIN sg ON md.symbol = sg.symbol AND md.ts = sg.ts", recursive=True),
    "keltner_chaikin": query(BARS_SQL, f"hl AS (SELECT *, high - low AS hl, {TR} AS tr FROM bars)", ADJUSTED("ke", "bars", "close", 20), ADJUSTED("ce", "hl", "hl", 10), f"kc AS (SELECT h.symbol, h.ts, {adjusted_value('ke', 20)} AS mid, 2 * ({roll('avg', 'tr', 10, 10).replace('symbol ORDER BY ts', 'h.symbol ORDER BY h.ts')}) AS wd, {adjusted_value('ce', 10)} AS e FROM hl h JOIN ke ON h.symbol = ke.symbol AND h.ts = ke.ts JOIN ce ON h.symbol = ce.symbol AND h.ts = ce.ts)", select=f"SELECT symbol, ts, round(mid, 5) AS keltner_middle, round(mid + wd, 5) AS keltner_upper, round(mid - wd, 5) AS keltner_lower, round((e - {lag('e', 10)}) / nullif({lag('e', 10)}, 0) * 100, 5) + 0.0 AS chaikin_vol_10_10 FROM kc", recursive=True),
    "vstop": query(BARS_SQL, TRB, wilder("w2", "trb", "tr", 20), f"vb AS (SELECT b.symbol, b.ts, b.close, {roll('avg', 'close', 13).replace('symbol ORDER BY ts', 'b.symbol ORDER BY b.ts')} AS m, w2.y AS a FROM bars b LEFT JOIN w2 ON b.symbol = w2.symbol AND b.ts = w2.ts)", "vk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM vb WHERE m IS NOT NULL AND a IS NOT NULL)",
        """vs AS (
  SELECT symbol, k, 1 AS t, m AS e, m - 2 * a AS s FROM vk WHERE k = 1
  UNION ALL
  SELECT symbol, k, CASE WHEN turn THEN -t ELSE t END, CASE WHEN turn THEN m ELSE e2 END, CASE WHEN turn THEN m + t * 2 * a ELSE s2 END
  FROM (SELECT *, (m - s2) * t < 0 AS turn FROM (SELECT *, CASE WHEN t > 0 THEN greatest(s, e2 - 2 * a) ELSE least(s, e2 + 2 * a) END AS s2 FROM (
    SELECT n.symbol, n.k, p.t, p.s, n.m, n.a, CASE WHEN p.t > 0 THEN greatest(p.e, n.m) ELSE least(p.e, n.m) END AS e2 FROM vs p JOIN vk n ON n.symbol = p.symbol AND n.k = p.k + 1))))""",
        select="SELECT b.symbol, b.ts, " + ", ".join(near(x, 5, n) for x, n in (("b.m", "sma_13"), ("b.a", "atr_20"), ("s", "vstop"), ("b.close / s", "price_vstop_ratio"), ("(b.close - s) / b.a", "price_vstop_gap_atr"))) + ", CAST(coalesce(t, 0) AS BIGINT) AS vstop_trend, CAST(sign(b.close - s) * t AS DOUBLE) AS vstop_interaction FROM vb b LEFT JOIN vk ON b.symbol = vk.symbol AND b.ts = vk.ts LEFT JOIN vs ON vs.symbol = vk.symbol AND vs.k = vk.k", recursive=True),
    "positions": labelled("SELECT symbol, ts, ret_index, CAST(CASE WHEN ret_index >= 252 THEN regime - 1 ELSE 0 END AS BIGINT) AS position FROM labels"),
    "filtered_positions": labelled("SELECT l.symbol, l.ts, l.ret_index, CAST(coalesce(h - 1, 0) AS BIGINT) AS position FROM labels l LEFT JOIN fl ON fl.symbol = l.symbol AND fl.t = l.ret_index",
        """fl AS (
  SELECT symbol, 251 AS t, 1 AS h, 0 AS c FROM (SELECT DISTINCT symbol FROM labels)
  UNION ALL
  SELECT n.symbol, n.ret_index, CASE WHEN n.regime <> h AND c + 1 >= 3 THEN n.regime ELSE h END, CASE WHEN n.regime = h OR c + 1 >= 3 THEN 0 ELSE c + 1 END
  FROM fl JOIN labels n ON n.symbol = fl.symbol AND n.ret_index = fl.t + 1)""", recursive=True).replace("coalesce(h - 1, 0)", "CASE WHEN l.ret_index >= 252 THEN h - 1 ELSE 0 END"),
    "equity": labelled(f"SELECT symbol, ts, ret_index, {r('pnl', 8)}, {r('equity', 8)} FROM eq", backtest_sql("labels")),
    "trades": labelled(f"SELECT symbol, CAST(trade AS BIGINT) AS trade, entry_index, exit_index, {r('profit', 7)} FROM trades", backtest_sql("labels")),
    "drawdown": labelled("SELECT symbol, round(max_drawdown, 7) + 0.0 AS max_drawdown, round(avg_drawdown, 7) + 0.0 AS avg_drawdown, max_duration, round(coalesce(avg_recovery, 0), 7) + 0.0 AS avg_recovery FROM ddm", backtest_sql("labels")),
    "ann_factor": query(BARS_SQL, RETS, select="SELECT symbol, CAST(CASE WHEN median(gap) <= 3600e6 THEN 8760 WHEN median(gap) <= 86400e6 THEN 252 WHEN median(gap) <= 7 * 86400e6 THEN 52 WHEN median(gap) <= 31 * 86400e6 THEN 12 ELSE 4 END AS BIGINT) AS ann_factor FROM (SELECT symbol, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM rets) GROUP BY symbol"),
    "backtest": labelled("SELECT symbol, n_equity, " + ", ".join(r(c, 6) for c in ("total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor")) + ", n_trades FROM met", backtest_sql("labels")),
    "weibull_fit": labelled(f"SELECT symbol, regime, n, {r('shape', 5)}, {r('scale', 5)} FROM fits", SPELLS, WEIBULL, recursive=True),
    "collapse_flag": labelled("SELECT symbol, len(low) > 0 AS degenerate, CASE WHEN len(low) > 0 THEN 'few bars in: ' || array_to_string(low, ', ') END AS caveat FROM (SELECT symbol, list_filter([CASE WHEN n_bear / n < 0.25 THEN 'bear' END, CASE WHEN n_sideways / n < 0.25 THEN 'sideways' END, CASE WHEN n_bull / n < 0.25 THEN 'bull' END], lambda x: x IS NOT NULL) AS low FROM (SELECT *, n_bear + n_sideways + n_bull AS n FROM now))", MATRIX, NOW),
    "low_data_flag": labelled("SELECT symbol, n_bear + n_sideways + n_bull AS n_bars, n_bear + n_sideways + n_bull < 588 AS low_data FROM now", MATRIX, NOW),
    "sweep_grid": swept("SELECT symbol, config_id, " + ", ".join(r(c, 6) for c in ("total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor")) + ', n_trades, "window", CAST(threshold AS DOUBLE) AS threshold, is_default FROM res'),
    "best_config": swept(f"SELECT symbol, metric, config_id, {r('value', 6)} FROM best", BEST),
    "extremes": swept(f"SELECT side, symbol, config_id, {r('sharpe', 6)} FROM (SELECT * FROM (SELECT 'top' AS side, * FROM res WHERE sharpe IS NOT NULL ORDER BY sharpe DESC, symbol, config_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bottom' AS side, * FROM res WHERE sharpe IS NOT NULL ORDER BY sharpe, symbol, config_id LIMIT 10))"),
    "composite_score": swept(f"SELECT symbol, config_id, round(0.30 * {z('sharpe')} + 0.25 * {z('total_return')} + 0.20 * {z('max_drawdown')} + 0.15 * {z('win_rate')} + 0.10 * {z('profit_factor')}, 5) + 0.0 AS score FROM res"),
    "win_counts": swept("SELECT \"window\", count(*) AS wins FROM best JOIN res USING (symbol, config_id) WHERE metric = 'sharpe' GROUP BY 1", BEST),
    "top3_frequency": swept("SELECT 'window' AS parameter, CAST(\"window\" AS VARCHAR) AS value, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, config_id) AS k FROM res WHERE sharpe IS NOT NULL) WHERE k <= 3 GROUP BY 2"),
    "rank_configs": swept("SELECT config_id, round(avg(sharpe), 6) + 0.0 AS mean, round(list_sort(list(sharpe))[count(*) // 2 + 1], 6) + 0.0 AS median, round(avg(CASE WHEN sharpe > 0.1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS positive_share, count(*) AS n FROM res WHERE sharpe IS NOT NULL GROUP BY config_id"),
    "parameter_impact": swept("SELECT 'window' AS parameter, CAST(\"window\" AS VARCHAR) AS value, round(avg(sharpe), 6) + 0.0 AS mean, round(stddev_pop(sharpe), 6) + 0.0 AS deviation, round(min(sharpe), 6) + 0.0 AS least, round(max(sharpe), 6) + 0.0 AS most, count(*) AS n FROM res WHERE sharpe IS NOT NULL GROUP BY 2"),
    "versus_default": swept("SELECT symbol, config_id, round(sharpe, 6) + 0.0 AS value, round(base, 6) + 0.0 AS base, round(sharpe - base, 6) + 0.0 AS lift FROM (SELECT *, max(sharpe) FILTER (is_default) OVER (PARTITION BY symbol) AS base FROM res)"),
    "improved_counts": swept("SELECT config_id, count(*) FILTER (l > 0.01) AS improved, count(*) FILTER (l < -0.01) AS worsened, count(*) FILTER (abs(l) <= 0.01) AS neutral FROM (SELECT *, sharpe - max(sharpe) FILTER (is_default) OVER (PARTITION BY symbol) AS l FROM res) WHERE l IS NOT NULL GROUP BY config_id"),
    "default_vs_best": swept("SELECT metric, round(avg(base), 6) + 0.0 AS mean_default, round(avg(value), 6) + 0.0 AS mean_best, round(avg(value) - avg(base), 6) + 0.0 AS lift FROM best JOIN (" + " UNION ALL ".join(f"SELECT symbol, '{m}' AS metric, {m} AS base FROM res WHERE is_default" for m in METRICS) + ") USING (symbol, metric) GROUP BY metric", BEST),
    "engine_agreement": labelled("SELECT symbol, 2 AS engines, a = b AS agree FROM (SELECT l.symbol, arg_max(l.regime, l.ret_index) AS a, arg_max(o.regime, o.ret_index) AS b FROM labels l JOIN other o ON l.symbol = o.symbol AND l.ret_index = o.ret_index GROUP BY l.symbol)", label_sql("other", 40, 0.08)),
    "skip_done": swept("SELECT symbol, config_id, \"window\", CAST(threshold AS DOUBLE) AS threshold, is_default FROM (SELECT DISTINCT symbol FROM rets) CROSS JOIN grid WHERE config_id % 2 = 1"),
    "refit_schedule": query(BARS_SQL, RETS, select="SELECT DISTINCT symbol, CAST(t AS BIGINT) AS refit FROM (SELECT symbol, unnest(list_append(range(252, last + 1, 50), last)) AS t FROM (SELECT symbol, max(ret_index) AS last FROM rets GROUP BY symbol HAVING max(ret_index) >= 252))"),
    "carry_forward": labelled("SELECT symbol, ts, ret_index, CAST(coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ret_index ROWS UNBOUNDED PRECEDING), 1) AS BIGINT) AS regime FROM (SELECT *, CASE WHEN ret_index >= 252 AND ((ret_index - 252) % 50 = 0 OR ret_index = max(ret_index) OVER (PARTITION BY symbol)) THEN regime END AS f FROM labels)"),
    "backfill": query(BARS_SQL, f"a AS (SELECT *, {roll('avg', 'close', 20)} AS s FROM bars)", select="SELECT symbol, ts, " + near("first_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", 6, "sma_20") + " FROM a"),
    "zscore_expanding": query(BARS_SQL, f"a AS (SELECT *, ln(close / {lag('close')}) AS lr FROM bars)", select="SELECT symbol, ts, round(z, 5) + 0.0 AS z_log_ret FROM (SELECT *, (lr - avg(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / (stddev_pop(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-8) AS z FROM a) WHERE bar_index >= 50"),
    "midstream_collapse": labelled("SELECT symbol, count(*) FILTER (n >= 20 AND least(a, b, c) / n < 0.05) AS collapsed_bars, count(*) AS bars FROM (SELECT symbol, count(*) OVER w AS n, count(*) FILTER (regime = 0) OVER w AS a, count(*) FILTER (regime = 1) OVER w AS b, count(*) FILTER (regime = 2) OVER w AS c FROM labels WHERE ret_index >= 252 WINDOW w AS (PARTITION BY symbol ORDER BY ret_index ROWS UNBOUNDED PRECEDING)) GROUP BY symbol"),
    "over_robust_flag": labelled(
        "SELECT symbol, round(rb, 6) + 0.0 AS share_bear, round(rs, 6) + 0.0 AS share_sideways, round(ru, 6) + 0.0 AS share_bull, round(pb, 6) + 0.0 AS plain_bear, round(ps, 6) + 0.0 AS plain_sideways, round(pu, 6) + 0.0 AS plain_bull, abs(rb - pb) < 0.1 AND abs(rs - ps) < 0.1 AND abs(ru - pu) < 0.1 AS over_robust FROM (SELECT symbol, avg((o.regime = 0)::INT) AS rb, avg((o.regime = 1)::INT) AS rs, avg((o.regime = 2)::INT) AS ru, avg((l.regime = 0)::INT) AS pb, avg((l.regime = 1)::INT) AS ps, avg((l.regime = 2)::INT) AS pu FROM labels l JOIN other o USING (symbol, ret_index) GROUP BY symbol)",
        label_sql("other", 10, 0.05)),
    "validate_results": labelled("SELECT symbol, 'no trades' AS problem FROM met WHERE n_trades IS NULL UNION ALL SELECT symbol, 'empty regime' FROM now WHERE least(n_bear, n_sideways, n_bull) = 0", MATRIX, NOW, backtest_sql("labels")),
}
