"""The classifier on planted tables, and its accuracy on rows it hasn't learned from."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def test_features():
    at, x = quality.Hasher().features("One one one!! Two")
    assert len(at) == len(set(at)) and np.isclose(np.sqrt((x**2).sum()), quality.NORM)
    assert quality.Hasher().features("")[0].size == 0 and quality.Hasher().features(" \n")[0].size == 0


@pytest.mark.parametrize("shard", [1024, 10])
def test_learns_and_holds_out(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD_DOCS", shard)
    text = lambda i: f"a plain line of words {i} about things." if i % 3 else f"BUY!! NOW!! {i} CHEAP!!"
    rows = [(i, text(i), "s") for i in range(120)] + [(None, "no id", None), (500, None, None), (501, "", None), (1, text(1), None), (502, "word " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 1) for i in range(80)] + [(5, None, 0), (None, 1, 0), (9999, 1, 0), (3, 0, 1)], "doc_id long, quality int, y int")
    weights = quality.fit(docs.select("doc_id", "text"), labels)
    out = [r for r in quality.score(docs, weights).collect()]
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all((r.score >= 0.7) == bool(r.doc_id % 3) for r in out if r.doc_id is not None and r.doc_id < 120)
    empty = {r.score for r in out if r.doc_id in (500, 501)}
    assert len(empty) == 1
    # Labels of held-out rows don't matter.
    turned = spark.createDataFrame([(i, int(i % 3 != 0) if zlib.crc32(str(i).encode()) % 4 != 2 else int(i % 3 == 0), 1) for i in range(80)], "doc_id long, quality int, y int")
    assert np.allclose(quality.fit(docs.select("doc_id", "text"), turned), weights)


def plain_ftrl(rows, epochs, shards):
    """FTRL-proximal on one feature at a time (McMahan et al. 2013); between epochs the
    shards' sums are averaged over the shards that touched a feature."""
    z, n = {}, {}

    def weight(zi, ni):
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        ends = []
        for shard in shards:
            zs, ns, touched = dict(z), dict(n), set()
            for doc in sorted(shard, key=lambda d: zlib.crc32(str(d).encode())):
                y, features = rows[doc]
                p = 1 / (1 + math.exp(-sum(weight(zs.get(i, 0.0), ns.get(i, 0.0)) * v for i, v in features)))
                for i, v in features:
                    g, old, w = (p - y) * v, ns.get(i, 0.0), weight(zs.get(i, 0.0), ns.get(i, 0.0))
                    zs[i] = zs.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w
                    ns[i] = old + g * g
                    touched.add(i)
            ends.append((zs, ns, touched))
        for i in set().union(*(t for _, _, t in ends)):
            seen = [(a[i], b[i]) for a, b, t in ends if i in t]
            z[i], n[i] = sum(a for a, _ in seen) / len(seen), sum(b for _, b in seen) / len(seen)
    return {i: weight(z[i], n[i]) for i in z}


@pytest.mark.parametrize("shard", [1024, 20])
def test_weights_and_scores_of_plain_ftrl(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD_DOCS", shard)
    rnd = random.Random(8)
    texts = {i: " ".join(rnd.choice(["good", "fine", "Bad", "BAD!!", "line", "9"]) for _ in range(rnd.randint(0, 12))) for i in range(60)}
    ys = {i: rnd.randint(0, 1) for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame(list(ys.items()), "doc_id long, quality int")
    weights = quality.fit(docs, labels)
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    hasher, bias = quality.Hasher(), 1 << quality.BITS
    rows = {i: (ys[i], [*zip(*(a.tolist() for a in hasher.features(texts[i])), strict=True), (bias, 1.0)]) for i in texts}
    n_shards = -(-len(learned) // shard)
    number = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).alias("s")).collect()}
    want = plain_ftrl(rows, quality.EPOCHS, [[i for i in learned if number[i] == s] for s in range(n_shards)])
    got = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}
    assert got.keys() == {i for i, w in want.items() if w} and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)
    for r in quality.score(docs, weights).collect():
        assert math.isclose(r.score, 1 / (1 + math.exp(-sum(want.get(i, 0.0) * v for i, v in rows[r.doc_id][1]))), rel_tol=1e-9)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not none.any() and quality.score(docs, none).first().score == 0.5
    assert quality.score(docs.where("false"), none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.op3_quality_ftrl(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "quality").collect()
    assert len(found) > 50 and np.mean([r.predicted == r.quality for r in found]) > 0.93
