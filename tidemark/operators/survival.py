"""How long regimes last: Weibull fits, remaining life, proportional hazards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import gamma
from tidemark.tables import discard, save

MIN_SPELLS = 3
BISECTIONS, NODES = 60, 400


def weibull_fit(runs: DataFrame) -> DataFrame:
    """(symbol, regime, n, shape, scale): maximum likelihood over the completed spells
    of each regime; null with fewer than three; equal durations give shape 1 and
    their mean. The shape is the root of the profile likelihood's slope, which rises
    with it, by bisection of its logarithm; the scale follows in closed form.

    Spells are counted by duration first. A regime's distinct durations add up to no more
    than its bars, so of n bars there are below the root of 2 n of them."""
    done = runs.where("not censored").groupBy("symbol", "regime", "duration").agg(F.count("*").alias("m"))
    done = done.groupBy("symbol", "regime").agg(F.collect_list(F.struct(F.col("duration").cast("double").alias("d"), F.col("m"))).alias("d"), F.sum("m").cast("int").alias("n"), F.max("duration").cast("double").alias("top"), (F.min("duration") == F.max("duration")).alias("flat"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["m"] * f(x["d"]))
    done = done.withColumn("mean_log", total(F.col("d"), lambda x: F.ln(x / F.col("top"))) / F.col("n"))

    def halve(s, _):
        k = F.exp((s["lo"] + s["hi"]) / 2)
        num = total(F.col("d"), lambda x: F.pow(x / F.col("top"), k) * F.ln(x / F.col("top")))
        slope = num / total(F.col("d"), lambda x: F.pow(x / F.col("top"), k)) - 1 / k - F.col("mean_log")
        return F.struct(F.when(slope > 0, s["lo"]).otherwise((s["lo"] + s["hi"]) / 2).alias("lo"), F.when(slope > 0, (s["lo"] + s["hi"]) / 2).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(math.log(1e-3)).alias("lo"), F.lit(math.log(1e3)).alias("hi"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)
    done = done.withColumn("root", root)
    k = F.exp((F.col("root.lo") + F.col("root.hi")) / 2)
    done = done.withColumn("shape", F.when(F.col("n") < MIN_SPELLS, None).when(F.col("flat"), 1.0).otherwise(k))
    scale = F.col("top") * F.pow(total(F.col("d"), lambda x: F.pow(x / F.col("top"), F.col("shape"))) / F.col("n"), 1 / F.col("shape"))
    return done.select("symbol", "regime", "n", "shape", F.when(F.col("flat") & (F.col("n") >= MIN_SPELLS), F.col("top")).otherwise(scale).alias("scale"))


def survival_columns(shape="shape", scale="scale", t="days_in_regime"):
    """hazard, median_survival, expected_remaining of Weibull columns at age ``t``.
    The remaining life is the integral of S over S(t), by Simpson's rule in u, where
    the age is t + (u / (1 - u)) scale, on fixed nodes."""
    k, s, age = F.col(shape), F.col(scale), F.greatest(F.col(t).cast("double"), F.lit(0.0))
    hazard = F.when(age > 0, k / s * F.pow(age / s, k - 1))
    step = 1.0 / NODES

    def at(i):
        u = i * step
        x = u / (1 - u)
        f = F.exp(F.pow(age / s, k) - F.pow(age / s + x, k)) / F.pow(1 - u, F.lit(2.0))
        return F.when(i == NODES, 0.0).otherwise(f)

    weight = lambda i: F.when((i == 0) | (i == NODES), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(NODES - 1)), F.lit(0.0), lambda a, i: a + weight(i) * at(i)) * step / 3
    return {"hazard_rate": hazard, "survival_50pct": s * F.pow(F.lit(math.log(2.0)), 1 / k), "expected_remaining_days": area * s}


def duration_forecast(runs: DataFrame) -> DataFrame:
    """Per symbol: the current regime, its age, and what its Weibull fit forecasts."""
    now = runs.where("censored").select("symbol", "regime", F.col("duration").alias("days_in_regime"))
    return now.join(weibull_fit(runs), ["symbol", "regime"], "left").withColumns(survival_columns()).withColumnRenamed("shape", "weibull_shape").withColumnRenamed("scale", "weibull_scale")


def expected_total(shape="weibull_shape", scale="weibull_scale"):
    return F.col(scale) * gamma(1 + 1 / F.col(shape))


def concordance(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, concordance) of ``scored(keys, duration, r)``: of the pairs of unequal
    durations, the share in which the shorter one has the larger r, ties as halves.

    Durations are ranked from 0. Two unequal ranks have a highest bit in which they
    differ; above it they are the same. So per bit, among the spells that share the
    bits above, those with a 0 are shorter than those with a 1, and a running count in
    order of r says of how many r is less or equal. No pair is formed.
    """
    ranked = scored.select(*keys, "r", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("duration")) - 1).alias("rank"))
    ranked = ranked.withColumn("top", F.max("rank").over(Window.partitionBy(*keys)))
    bits = ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.length(F.bin("top")) - 1)))
    power = F.call_function("shiftleft", F.lit(1), F.col("bit"))
    bits = bits.select(*keys, "r", "bit", F.floor(F.col("rank") / (power * 2)).alias("above"), F.pmod(F.floor(F.col("rank") / power), F.lit(2)).alias("longer"))
    group = Window.partitionBy(*keys, "bit", "above")
    shorter = lambda w: F.coalesce(F.sum(1 - F.col("longer")).over(w), F.lit(0))
    by_r = group.orderBy("r")
    counted = bits.withColumns({"all": shorter(group), "upto": shorter(by_r.rangeBetween(Window.unboundedPreceding, 0)), "tied": shorter(by_r.rangeBetween(0, 0))}).where("longer = 1")
    return counted.groupBy(*keys).agg(F.try_divide(F.sum(F.col("all") - F.col("upto") + F.col("tied") / 2), F.sum("all")).alias("concordance"))


def cox_fit(covariates: DataFrame, rounds: int = 20) -> DataFrame:
    """(symbol, regime, n, beta_volatility, beta_return, concordance): proportional
    hazards on completed spells of each symbol's regime, ties as Breslow.

    Covariates are standardised. A Newton step needs, at each duration, sums over the
    spells that last as long or longer: sums per distinct duration, running totals of
    those, then totals per group and a 2 x 2 solve on one row each. All groups step
    together; their betas are a stored table, and only whether any still moves comes to
    the driver."""
    keys = ["symbol", "regime"]
    whole = Window.partitionBy(*keys)
    rows = covariates.where("event").withColumn("n", F.count("*").over(whole)).where(F.col("n") >= MIN_SPELLS)
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(whole), F.stddev_pop(c).over(whole)), F.lit(0.0))
    rows = save(rows.select(*keys, "duration", "n", z("volatility").alias("x"), z("total_log_return").alias("y")), "spells")
    beta = rows.select(*keys).distinct().withColumns({"bx": F.lit(0.0), "by": F.lit(0.0)})
    risk = Window.partitionBy(*keys).orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    used, stored = [], None
    for _ in range(rounds):
        e, x, y = F.col("e"), F.col("x"), F.col("y")
        d = rows.join(beta, keys).withColumn("e", F.exp(F.col("bx") * x + F.col("by") * y))
        sums = {"s": e, "sx": e * x, "sy": e * y, "sxx": e * x * x, "sxy": e * x * y, "syy": e * y * y}
        d = d.groupBy(*keys, "bx", "by", "duration").agg(F.count("*").alias("m"), F.sum("x").alias("x"), F.sum("y").alias("y"), *[F.sum(c).alias(name) for name, c in sums.items()])
        d = d.withColumns({name: F.sum(name).over(risk) for name in sums})
        q = lambda c: F.col(c) / F.col("s")
        m = F.col("m")
        t = d.groupBy(*keys, "bx", "by").agg(F.sum(x - m * q("sx")).alias("gx"), F.sum(y - m * q("sy")).alias("gy"), (F.sum(m * (q("sxx") - q("sx") * q("sx"))) + 1e-6).alias("a"), F.sum(m * (q("sxy") - q("sx") * q("sy"))).alias("b"), (F.sum(m * (q("syy") - q("sy") * q("sy"))) + 1e-6).alias("c"))
        det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
        clip = lambda v: F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)), F.lit(0.0))
        step = t.select(*keys, "bx", "by", clip(F.try_divide(F.col("c") * F.col("gx") - F.col("b") * F.col("gy"), det)).alias("dx"), clip(F.try_divide(F.col("a") * F.col("gy") - F.col("b") * F.col("gx"), det)).alias("dy"))
        stored = save(step.select(*keys, (F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"), F.greatest(F.abs("dx"), F.abs("dy")).alias("moved")), "betas")
        discard(*used)
        used, beta = [stored], stored.select(*keys, "bx", "by")
        if stored.where("moved >= 1e-9").isEmpty():
            break
    scored = rows.join(beta, keys).withColumn("r", F.col("bx") * F.col("x") + F.col("by") * F.col("y"))
    conc = concordance(scored, keys)
    sizes = rows.groupBy(*keys).agg(F.max("n").alias("n"))
    return beta.join(sizes, keys).join(conc, keys, "left").select(*keys, "n", F.col("bx").alias("beta_volatility"), F.col("by").alias("beta_return"), "concordance")


def cox_forecast(covariates: DataFrame, fits: DataFrame) -> DataFrame:
    """Per symbol, for the spell it is in: (symbol, regime, days_in_regime,
    baseline_hazard_at_t, cox_expected_remaining_days), from ``cox_fit``'s rows.

    The baseline hazard at a duration is the number of spells that end there over the
    summed risks of those that last as long or longer, at mean covariates (Breslow).
    The remaining life is the integral of S over S at the first duration not below the
    age, by trapezoids on the durations; beyond the last one there is none."""
    keys = ["symbol", "regime"]
    done = covariates.where("event").join(fits.select(*keys, "beta_volatility", "beta_return"), keys)
    group = Window.partitionBy(*keys)
    facts = {f"{k}_{c}": f(c).over(group) for c in ("volatility", "total_log_return") for k, f in (("m", F.avg), ("s", F.stddev_pop))}
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), f"s_{c}"), F.lit(0.0))
    risk = lambda: F.exp(F.col("beta_volatility") * z("volatility") + F.col("beta_return") * z("total_log_return"))
    at = done.withColumns(facts).withColumn("e", risk()).groupBy(*keys, "duration").agg(F.sum("e").alias("e"), F.count("*").alias("d"), *[F.first(c).alias(c) for c in facts], F.first("beta_volatility").alias("beta_volatility"), F.first("beta_return").alias("beta_return"))
    later = Window.partitionBy(*keys).orderBy("duration")
    at = at.withColumn("h", F.col("d") / F.sum("e").over(later.rowsBetween(0, Window.unboundedFollowing)))
    at = at.withColumn("cumulated", F.sum("h").over(later.rowsBetween(Window.unboundedPreceding, 0)))
    now = covariates.where("not event").select(*keys, F.col("duration").alias("days_in_regime"), "volatility", "total_log_return")
    ahead = now.join(at, keys).where("duration >= days_in_regime").withColumn("survival", F.exp(-F.col("cumulated") * risk()))
    ahead = ahead.withColumns({"t2": F.lead("duration").over(later), "s2": F.lead("survival").over(later)})
    area = F.sum((F.col("survival") + F.col("s2")) / 2 * (F.col("t2") - F.col("duration")))
    found = ahead.groupBy(*keys).agg(F.min_by("h", "duration").alias("baseline_hazard_at_t"), (F.coalesce(area, F.lit(0.0)) / F.min_by("survival", "duration")).alias("cox_expected_remaining_days"))
    out = now.join(fits.select(*keys), keys).join(found, keys, "left")
    return out.select(*keys, "days_in_regime", "baseline_hazard_at_t", F.coalesce("cox_expected_remaining_days", F.lit(0.0)).alias("cox_expected_remaining_days"))
