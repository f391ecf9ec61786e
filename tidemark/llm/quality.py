"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, save, table

BITS = 18
#: Learning takes at most so many labelled documents, those of the smallest hash of
#: their id; each shard of them is learned in order, shards side by side.
SAMPLE_DOCS, SHARD_DOCS, EPOCHS = 8192, 1024, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.05
#: Features have this Euclidean norm.
NORM = 3.0
THRESHOLD = 0.7
WORDS = re.compile(r"\w+|[^\w\s]+")
MEMO_ENTRIES = 400_000


class Hasher:
    """Hashed features of a text: words and runs of signs, pairs of neighbours,
    pairs of neighbours' shapes, and pairs of equal neighbours."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.memo: dict[str, tuple[int, int]] = {}

    def _hash(self, word: str) -> tuple[int, int]:
        shape = "x" if word.islower() else "XX" if len(word) > 1 and word.isupper() else "X" if word[0].isalpha() else "0" if word[0].isdigit() else word[:3]
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        found = self.memo[word] = (zlib.crc32(word.encode()), zlib.crc32(b"shape " + shape.encode()))
        return found

    def features(self, text: str):
        """(indices, values): counts scaled to a norm of ``NORM``; none for no words."""
        import numpy as np

        get, make = self.memo.get, self._hash
        pairs = [get(w) or make(w) for w in WORDS.findall(text)]
        if not pairs:
            return np.empty(0, np.int64), np.empty(0)
        both = np.array(pairs, np.uint64)
        word, shape = both[:, 0], both[:, 1]
        mask = np.uint64(self.mask)
        next_to = (word[:-1] * np.uint64(0x9E3779B1) + word[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        shapes = (shape[:-1] * np.uint64(0xC2B2AE35) + shape[1:] * np.uint64(0x27D4EB2F)) >> np.uint64(9)
        same = np.full(int((word[:-1] == word[1:]).sum()), zlib.crc32(b"same twice"), np.uint64)
        index, count = np.unique((np.concatenate([word, next_to, shapes, same]) & mask).astype(np.int64), return_counts=True)
        return index, count * (NORM / float(np.sqrt(np.dot(count, count.astype(float)))))


def weights_of(z, n):
    """FTRL-proximal weights of the sums of gradients and of their squares."""
    import numpy as np

    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample_docs: int = SAMPLE_DOCS):
    """Weights (numpy, 2**bits and the bias last) learned from ``labels(doc_id,
    quality)`` on ``docs(doc_id, text)``; held-out and unlabelled rows play no part.

    A round learns each shard on from the common state and averages what the
    shards that touched a feature made of it. So with one shard it is FTRL on one
    stream, with more it is an average of such runs between rounds. What reaches the driver is the state
    of at most 2**bits features. Null labels and ids are passed over; of several
    labels or texts of an id the smallest counts; without labels all weights are 0.
    """
    import numpy as np

    spark = docs.sparkSession
    size = (1 << bits) + 1
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    n_shards = max(1, -(-chosen.count() // SHARD_DOCS))

    def vectors(batches):
        import pyarrow as pa

        hasher = Hasher(bits)
        for batch in batches:
            ids, ys = batch.column(0), batch.column(1)
            made = [hasher.features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([ids, ys, pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["doc_id", "y", "at", "x"])

    rows = save(sample.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text").mapInArrow(vectors, "doc_id long, y int, at array<long>, x array<double>").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards))), "features")
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))

        def learn(group):
            import pyarrow as pa

            z, n = (a.copy() for a in state.value)
            touched = np.zeros(size, bool)
            order = np.argsort([zlib.crc32(str(i).encode()) for i in group.column("doc_id").to_pylist()], kind="stable")
            for k in order:
                at = np.append(group.column("at")[int(k)].values.to_numpy(), size - 1)
                x = np.append(group.column("x")[int(k)].values.to_numpy(), 1.0)
                w = weights_of(z[at], n[at])
                gradient = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - group.column("y")[int(k)].as_py()) * x
                sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
                z[at] += gradient - sigma * w
                n[at] += gradient**2
                touched[at] = True
            at = np.flatnonzero(touched)
            return pa.table({"at": pa.array(at, pa.int64()), "z": pa.array(z[at]), "n": pa.array(n[at])})

        found = rows.groupBy("shard").applyInArrow(learn, "at long, z double, n double").groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
        z, n = z.copy(), n.copy()
        at = found.column("at").to_numpy()
        z[at], n[at] = found.column("z").to_numpy(), found.column("n").to_numpy()
    return weights_of(z, n)


def score(docs: DataFrame, weights, bits: int = BITS) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) to ``docs``, which needs ``text``.
    A null or empty text has the bias alone. Memory is that of a batch of rows, and of
    the features of one text however long. A column called score is replaced."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in docs.columns if c != "score"]

    def dots(batches):
        import pyarrow as pa

        hasher, w = Hasher(bits), shared.value
        for batch in batches:
            out = []
            for cell in batch.column(names.index("text")):
                at, x = hasher.features(cell.as_py() or "")
                out.append(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([docs.schema[c] for c in names]).add("score", DoubleType())
    return docs.select(*[quoted(c) for c in names]).mapInArrow(dots, schema)


def op3_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
