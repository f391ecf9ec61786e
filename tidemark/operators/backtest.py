"""Positions, profit, equity, risk and trades of regime labels, without lookahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import save

#: A run of a strategy is a symbol, or a symbol and a configuration.
SYMBOL = ("symbol",)


def _w(keys):
    return Window.partitionBy(*keys).orderBy("ret_index")


def replay(labels: DataFrame, min_train: int = 252) -> DataFrame:
    return labels.where(F.col("ret_index") >= min_train)


def positions(labels: DataFrame, min_train: int = 252) -> DataFrame:
    """1 for bull, -1 for bear, else 0; 0 before ``min_train`` returns."""
    return labels.withColumn("position", F.when(F.col("ret_index") >= min_train, F.col("regime") - 1).otherwise(0))


#: Bars of a run that the filters fold at a time.
FOLD = 256


def filtered_positions(labels: DataFrame, min_train: int = 252, dwell_bars: int = 0, hysteresis: float = 0.0, keys=SYMBOL, fold: int = FOLD) -> DataFrame:
    """Positions that change only after ``dwell_bars`` bars off the held regime and, if
    labels have a ``posterior`` array, if the new regime's posterior exceeds the held
    one's, as stored at the last switch, by more than ``hysteresis``.

    The counter counts any bar that differs from the held regime. With both at 0
    this is ``positions``. Else a run is cut into blocks of ``fold`` bars. With a dwell
    alone there are few states, held regime and counter: each block maps every state to
    the one it ends in, the maps are composed by doubling over blocks, and each block is
    replayed from its start. With a posterior the state holds numbers: blocks are folded
    from the states that the blocks before ended in, until none changes; one that
    switches forgets how it began, so few rounds do."""
    if dwell_bars <= 0 and hysteresis <= 0:
        return positions(labels, min_train)
    keys = list(keys)
    names = labels.columns
    sure = hysteresis > 0 and "posterior" in names
    bars = labels.where(F.col("ret_index") >= min_train).withColumn("block", F.floor((F.col("ret_index") - min_train) / fold))
    bar = F.struct("ret_index", F.col("regime").cast("int").alias("regime"), (F.col("posterior") if sure else F.lit(None).cast("array<double>")).alias("p"))
    blocks = bars.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    order = Window.partitionBy(*keys).orderBy("block")
    if sure:
        starts = _settled(blocks, order, keys, dwell_bars, hysteresis)
    else:
        starts = _composed(blocks, order, keys, dwell_bars)
    replayed = F.aggregate("bars", F.struct(F.col("start").alias("s"), F.array().cast("array<int>").alias("out")), lambda acc, b: _replay(acc, b, dwell_bars, hysteresis), lambda acc: acc["out"])
    held = starts.withColumn("held", replayed)
    each = held.select(*keys, F.explode(F.arrays_zip(F.col("bars.ret_index").alias("t"), F.col("held").alias("h"))).alias("z")).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("z.t").alias("t"), F.col("z.h").alias("h"))
    same = F.col("ret_index") == F.col("t")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return labels.join(each, same, "left").select(*names, F.coalesce(F.col("h") - 1, F.lit(0)).cast("int").alias("position"))


def _step(s, b, dwell, hysteresis):
    """The state (held, count, stored) after a bar; the filter's two numbers may be columns."""
    off = b["regime"] != s["held"]
    count = F.when(off, s["count"] + 1).otherwise(0)
    lead = F.get(b["p"], b["regime"]) - F.get(s["stored"], s["held"])
    unasked = hysteresis <= 0 if isinstance(hysteresis, Column) else F.lit(hysteresis <= 0)
    sure = unasked | b["p"].isNull() | s["stored"].isNull() | F.coalesce(lead > hysteresis, F.lit(False))
    turn = off & (count >= dwell) & sure
    return F.struct(F.when(turn, b["regime"]).otherwise(s["held"]).alias("held"), F.when(turn, 0).otherwise(count).alias("count"), F.when(turn, b["p"]).otherwise(s["stored"]).alias("stored"))


def _replay(acc, b, dwell: int, hysteresis: float):
    after = _step(acc["s"], b, dwell, hysteresis)
    return F.struct(after.alias("s"), F.concat(acc["out"], F.array(after["held"])).alias("out"))


#: Before the first bar sideways is held.
START = "named_struct('held', 1, 'count', 0, 'stored', cast(null as array<double>))"


def _composed(blocks: DataFrame, order, keys: list[str], dwell: int) -> DataFrame:
    """``blocks`` with the state each starts in. A state is held * dwell + count; the
    counter stays below ``dwell``, as at that many a switch is due."""
    state = lambda i: F.struct(F.floor(i / dwell).cast("int").alias("held"), (i % dwell).cast("int").alias("count"), F.lit(None).cast("array<double>").alias("stored"))
    number = lambda s: s["held"] * dwell + s["count"]
    end = lambda i: F.aggregate("bars", state(i), lambda s, b: _step(s, b, dwell, 0.0), number)
    maps = save(blocks.select(*keys, "block", F.transform(F.sequence(F.lit(0), F.lit(3 * dwell - 1)), end).alias("to")), "filter-maps")
    most = (maps.agg(F.max("block")).first()[0] or 0) + 1
    step = 1
    while step < most:
        # The composition over 2 * step blocks is that over the later ones after the earlier.
        maps = maps.withColumn("before", F.lag("to", step).over(order)).withColumn("to", F.when(F.col("before").isNull(), F.col("to")).otherwise(F.transform("before", lambda i: F.get("to", i)))).drop("before")
        step *= 2
    began = F.coalesce(F.lag(F.get("to", F.lit(dwell))).over(order), F.lit(dwell))
    starts = maps.withColumn("began", began).select(*keys, "block", state(F.col("began")).alias("start"))
    return blocks.join(starts, [*keys, "block"])


def _settled(blocks: DataFrame, order, keys: list[str], dwell: int, hysteresis: float) -> DataFrame:
    """``blocks`` with the state each starts in, by rounds."""
    return _by_rounds(blocks, order, keys, F.expr(START), lambda s, b: _step(s, b, dwell, hysteresis))


def _by_rounds(blocks: DataFrame, order, keys: list[str], first: Column, step) -> DataFrame:
    ended = F.aggregate("bars", F.col("start"), step)
    blocks = save(blocks, "filter-blocks")
    folded = save(blocks.select(*keys, "block", first.alias("start")).join(blocks, [*keys, "block"]).select(*keys, "block", "start", ended.alias("end")), "filter-ends")
    while True:
        due = F.coalesce(F.lag("end").over(order), first)
        asked = folded.withColumn("due", due).withColumn("wrong", ~F.col("start").eqNullSafe(F.col("due")))
        if asked.where("wrong").isEmpty():
            return blocks.join(folded.select(*keys, "block", "start"), [*keys, "block"])
        right = asked.where("not wrong").select(*keys, "block", "start", "end")
        again = asked.where("wrong").select(*keys, "block", F.col("due").alias("start")).join(blocks, [*keys, "block"]).select(*keys, "block", "start", ended.alias("end"))
        folded = save(right.unionAll(again), "filter-ends")


def filtered_many(labels: DataFrame, filters: list[tuple[int, float]], min_train: int = 252, keys=SYMBOL, fold: int = FOLD) -> DataFrame:
    """``labels`` with ``positions``, an array with a position for each of ``filters``
    (bars to dwell, least lead of the posterior), as ``filtered_positions`` has them. The
    bars are grouped and folded once, with an array of states, one per filter."""
    keys, names = list(keys), labels.columns
    bars = labels.where(F.col("ret_index") >= min_train).withColumn("block", F.floor((F.col("ret_index") - min_train) / fold))
    bar = F.struct("ret_index", F.col("regime").cast("int").alias("regime"), (F.col("posterior") if "posterior" in names else F.lit(None)).cast("array<double>").alias("p"), F.struct(*names).alias("row"))
    blocks = bars.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    given = F.array(*[F.struct(F.lit(int(d)).alias("dwell"), F.lit(float(h)).alias("lead")) for d, h in filters])
    step = lambda ss, b: F.zip_with(ss, given, lambda s, f: _step(s, b, f["dwell"], f["lead"]))
    starts = _by_rounds(blocks, Window.partitionBy(*keys).orderBy("block"), keys, F.array_repeat(F.expr(START), len(filters)), step)

    def replay(acc, b):
        after = F.transform(F.array(step(acc["s"], b)), lambda s: s)[0]
        return F.struct(after.alias("s"), F.concat(acc["out"], F.array(F.transform(after, lambda s: s["held"]))).alias("out"))

    held = F.aggregate("bars", F.struct(F.col("start").alias("s"), F.array().cast("array<array<int>>").alias("out")), replay, lambda acc: acc["out"])
    each = starts.withColumn("held", held).select(F.explode(F.arrays_zip(F.col("bars.row").alias("row"), F.col("held").alias("h"))).alias("z"))
    late = each.select(*[F.col("z.row").getField(c).alias(c) for c in names], F.transform("z.h", lambda h: h - 1).alias("positions"))
    early = labels.where(F.col("ret_index") < min_train).withColumn("positions", F.array_repeat(F.lit(0), len(filters)))
    return early.unionByName(late)


def pnl(keys=SYMBOL):
    """The position held over a bar times its return."""
    return F.coalesce(F.lag("position").over(_w(keys)) * F.col("ret"), F.lit(0.0))


FACTORS = ("logs", "negative", "zeros")


def factors() -> dict:
    """Parts of the factor 1 + pnl whose running totals make the running product."""
    factor = 1 + F.col("pnl")
    return {"logs": F.ln(F.when(factor != 0, F.abs(factor))), "negative": (factor < 0).cast("int"), "zeros": (factor == 0).cast("int")}


def product():
    """The running product of the factors, from the totals ``FACTORS``."""
    sign = F.when(F.round("negative").cast("long") % 2 == 0, 1.0).otherwise(-1.0)
    return F.when(F.col("zeros") > 0, 0.0).otherwise(F.coalesce(F.exp("logs"), F.lit(1.0)) * sign)


def equity(rows: DataFrame, min_train: int = 252, keys=SYMBOL) -> DataFrame:
    """Add pnl (the position held over the bar times its return) and equity, the
    running product of 1 + pnl, null before ``min_train``. Factors may be zero or
    negative: their logs are summed and signs counted."""
    run = _w(keys).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("pnl", pnl(keys))
    d = d.withColumns({name: F.sum(c).over(run) for name, c in factors().items()})
    return d.withColumn("equity", F.when(F.col("ret_index") >= min_train, product())).drop(*FACTORS)


def _bars_a_year(gap: str):
    m, day = F.median(gap), 86400
    return F.when(m <= 3600, 8760).when(m <= day, 252).when(m <= 7 * day, 52).when(m <= 31 * day, 12).otherwise(4)


def ann_factor(rows: DataFrame, keys=SYMBOL) -> DataFrame:
    """Bars a year, by the median gap between bars: 8760 up to an hour, 252 up to a
    day, 52 to a week, 12 to a month, else 4."""
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(_w(keys))) / 1e6
    return rows.withColumn("gap", gap).groupBy(*keys).agg(_bars_a_year("gap").alias("ann_factor"))


def drawdown(rows: DataFrame, keys=SYMBOL) -> DataFrame:
    """(keys, max_drawdown, avg_drawdown, max_duration, avg_recovery) of the equity.
    A duration is a run of bars below the running maximum; a recovery counts the
    bars from the first one below, which isn't the first bar, to the one at it again."""
    w = _w(keys)
    d = rows.where("equity is not null").withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("dd", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak"))).withColumn("under", F.col("dd") < 0)
    d = d.withColumn("episode", F.sum((~F.col("under")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("ends", F.lead("under").over(w) == F.lit(False))
    # An episode also holds the bar at the peak that it begins with, so every run of a
    # strategy has one, that of a null key and one never below its peak too.
    under = lambda c: F.when(F.col("under"), F.col(c))
    runs = d.groupBy(*keys, "episode").agg(F.count_if("under").alias("bars"), F.min(under("dd")).alias("deepest"), F.sum(under("dd")).alias("total"), F.max(under("ends")).alias("ended"))
    found = runs.groupBy(*keys).agg(F.min("deepest").alias("max_drawdown"), F.try_divide(F.sum("total"), F.sum("bars")).alias("avg_drawdown"), F.max("bars").alias("max_duration"), F.avg(F.when(F.col("ended"), F.col("bars"))).alias("avg_recovery"))
    return found.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("max_drawdown", "avg_drawdown")], "max_duration", F.coalesce("avg_recovery", F.lit(0.0)).alias("avg_recovery"))


def trades(rows: DataFrame, keys=SYMBOL) -> DataFrame:
    """(keys, trade, entry_index, exit_index, profit): a trade begins where a position
    follows none and ends at the next bar without one, or at the last bar; a turn from
    long to short doesn't end it. Its profit is between those bars' equities."""
    w = _w(keys)
    before = F.lag("position").over(w)
    d = rows.withColumn("entry", F.coalesce((F.col("position") != 0) & (before == 0), F.lit(False)))
    d = d.withColumns({"trade": F.sum(F.col("entry").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "open": (F.col("position") != 0) | F.coalesce(before != 0, F.lit(False))})
    found = d.where("trade > 0 and open").groupBy(*keys, "trade").agg(F.min("ret_index").alias("entry_index"), F.max("ret_index").alias("exit_index"), F.min_by("equity", "ret_index").alias("e0"), F.max_by("equity", "ret_index").alias("e1"))
    return found.select(*keys, "trade", "entry_index", "exit_index", (F.try_divide("e1", "e0") - 1).alias("profit"))


def metrics(rows: DataFrame, keys=SYMBOL, rate: float = 0.02) -> DataFrame:
    """(keys, n_equity, total_return, sharpe, max_drawdown, n_trades, win_rate,
    profit_factor). Sharpe counts the first change as 0; it is 0 if nothing varies. All
    but the keys are null with fewer than two bars of equity; profit_factor is null
    without losers. All comes from one pass of windows and one grouping."""
    keys, w = list(keys), _w(keys)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before, earlier = F.lag("position").over(w), F.lag("equity").over(w)
    d = rows.select(*keys, "ret_index", "ts", "equity", "position")
    d = d.withColumns(
        {
            "step": F.when(F.col("equity").isNotNull(), F.coalesce(F.try_divide("equity", earlier) - 1, F.lit(0.0))),
            "gap": F.when(F.col("equity").isNotNull() & earlier.isNotNull(), (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6),
            "dd": F.try_divide(F.col("equity") - F.max("equity").over(run), F.max("equity").over(run)),
            "entry": F.coalesce((F.col("position") != 0) & (before == 0), F.lit(False)),
            "open": (F.col("position") != 0) | F.coalesce(before != 0, F.lit(False)),
        }
    )
    d = d.withColumn("under", F.col("dd") < 0)
    ended = F.col("open") & (F.max("entry").over(run)) & ~(F.coalesce(F.lead("open").over(w), F.lit(False)) & ~F.coalesce(F.lead("entry").over(w), F.lit(False)))
    start = F.last(F.when(F.col("entry"), F.col("equity")), ignorenulls=True).over(run)
    d = d.withColumns({"profit": F.when(ended, F.try_divide("equity", start) - 1), "closed": ended})
    first_last = [F.max_by("equity", F.when(F.col("equity").isNotNull(), F.col("ret_index"))).alias("e1"), F.min_by("equity", F.when(F.col("equity").isNotNull(), F.col("ret_index"))).alias("e0")]
    made = [F.count_if("closed").alias("n"), F.avg(F.when(F.col("closed"), (F.col("profit") > 0).cast("double"))).alias("win_rate"), F.sum(F.when(F.col("profit") > 0, F.col("profit"))).alias("won"), F.sum(F.when(F.col("profit") < 0, -F.col("profit"))).alias("lost")]
    d = d.groupBy(*keys).agg(F.count("equity").alias("n_equity"), *first_last, F.avg("step").alias("mean"), F.stddev_samp("step").alias("sd"), _bars_a_year("gap").alias("ann_factor"), F.coalesce(F.min(F.when(F.col("under"), F.col("dd"))), F.lit(0.0)).alias("max_drawdown"), *made)
    enough = F.col("n_equity") >= 2
    sharpe = F.when(F.col("sd") == 0, 0.0).otherwise(F.sqrt("ann_factor") * (F.col("mean") - F.lit(rate) / F.col("ann_factor")) / F.col("sd"))
    return d.select(
        *keys, "n_equity", F.when(enough, F.try_divide("e1", "e0") - 1).alias("total_return"), F.when(enough, sharpe).alias("sharpe"),
        F.when(enough, F.col("max_drawdown")).alias("max_drawdown"), F.when(enough, F.col("n")).alias("n_trades"), F.when(enough, F.col("win_rate")).alias("win_rate"),
        F.when(enough & F.col("lost").isNotNull(), F.try_divide(F.coalesce("won", F.lit(0.0)), F.col("lost"))).alias("profit_factor"),
    )
