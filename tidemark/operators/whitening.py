"""Whitening by principal components, refit by refit, from running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-8


def refit_sums(features: DataFrame, columns: list[str], refits: DataFrame) -> DataFrame:
    """(symbol, refit, n, s, ss): for each refit the number of bars before it with all
    ``columns`` known, the sums of the features and of their products (the upper
    triangle by rows), as differences from the symbol's first such bar. Bars are summed
    by the interval between refits they fall into, then intervals are added up: what a
    refit costs doesn't grow with its history."""
    d = len(columns)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = features.select("symbol", "ret_index", x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    origin = rows.groupBy("symbol").agg(F.min_by("x", "ret_index").alias("origin"))
    marks = refits.select("symbol", F.col("refit").alias("ret_index"), F.col("refit").alias("mark"))
    # A bar belongs to the first refit after it.
    after = Window.partitionBy("symbol").orderBy(F.desc("ret_index")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(marks, ["symbol", "ret_index"], "full").withColumn("refit", F.min("mark").over(after)).where("x is not null and refit is not null")
    placed = placed.join(origin, "symbol").select("symbol", "refit", F.zip_with("x", "origin", lambda a, b: a - b).alias("x"))
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def added(key, interval):
        """Sums of one interval's bars, which are as many as lie between two refits."""
        import numpy as np
        import pyarrow as pa

        x = np.array(interval.column("x").to_pylist()).reshape(-1, d)
        both = x.T @ x
        cells = [float(len(x)), *map(float, x.sum(0)), *[float(both[i, j]) for i, j in upper]]
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "refit": pa.array([key[1].as_py()], pa.int32()), "c": pa.array([cells], pa.list_(pa.float64()))})

    width = 1 + d + len(upper)
    parts = placed.withColumn("refit", F.col("refit").cast("int")).groupBy("symbol", "refit").applyInArrow(added, "symbol string, refit int, c array<double>")
    every = refits.select("symbol", "refit").join(parts, ["symbol", "refit"], "left").withColumn("c", F.coalesce("c", F.array_repeat(F.lit(0.0), width)))
    upto = Window.partitionBy("symbol", "k").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    running = every.select("symbol", "refit", F.posexplode("c").alias("k", "v")).withColumn("v", F.sum("v").over(upto))
    sums = running.groupBy("symbol", "refit").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("c"))
    return sums.select("symbol", "refit", F.get("c", F.lit(0)).cast("int").alias("n"), F.slice("c", 2, d).alias("s"), F.slice("c", 2 + d, width).alias("ss"))


def covariances(sums: DataFrame, columns: list[str]) -> DataFrame:
    """(symbol, refit, n, i, j, covariance), i up to j, of each refit's sums."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cell = lambda k, i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.get("ss", F.lit(k)) / F.col("n") - F.get("s", F.lit(i)) * F.get("s", F.lit(j)) / F.col("n") / F.col("n")).alias("covariance"))
    return sums.where("n > 0").select("symbol", "refit", "n", F.explode(F.array(*[cell(k, i, j) for k, (i, j) in enumerate(pairs)])).alias("c")).select("symbol", "refit", "n", "c.*")


def whitening(sums: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """(symbol, refit, n, component, variance, explained, kept, weights) of each refit's
    sums: the components of its standardised features, largest first, kept until their
    variance adds to ``share`` of the whole (at least one). A whitened score is the dot
    product of ``weights`` with (x - mean) / (deviation + 1e-8); a component's sign is
    that of its largest weight. One small eigenproblem per refit, its history being in the
    sums; refits without bars have no components."""
    d = len(columns)

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        upper = np.triu_indices(d)
        names = ["symbol", "refit", "n", "component", "variance", "explained", "kept", "weights"]
        for batch in batches:
            rows = []
            for symbol, refit, n, s, ss in zip(*(batch.column(c).to_pylist() for c in ("symbol", "refit", "n", "s", "ss")), strict=True):
                if not n:
                    continue
                mean, second = np.array(s) / n, np.zeros((d, d))
                second[upper] = np.array(ss) / n
                second += np.triu(second, 1).T
                cov = second - np.outer(mean, mean)
                dev = np.sqrt(np.maximum(np.diag(cov), 0)) + TINY
                values, vectors = np.linalg.eigh(cov / np.outer(dev, dev))
                values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
                explained = values / max(values.sum(), TINY)
                kept = np.concatenate([[0.0], np.cumsum(explained)[:-1]]) < share
                for k in range(d):
                    w = vectors[:, k] * np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k])
                    rows.append((symbol, refit, n, k, float(values[k]), float(explained[k]), bool(kept[k]), list(map(float, w / np.sqrt(values[k] + TINY)))))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return sums.select("symbol", F.col("refit").cast("int"), "n", "s", "ss").mapInArrow(solve, "symbol string, refit int, n int, component int, variance double, explained double, kept boolean, weights array<double>")
