"""Near-duplicate embeddings: random-hyperplane hashing, exact cosines, components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, save, table

#: The largest label's vectors get so many bits more than it takes to number them, and
#: at least so many, so that buckets stay small as labels grow; there are as many tables
#: as it takes to miss a pair at the threshold with at most this probability.
SPARE_BITS, LEAST_BITS, MISS, SEED = 2, 16, 0.003, 20240229
THRESHOLD = 0.98
#: Vectors of a bucket that meet in one task, as rows of a matrix product.
TILE = 512


def code_size(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for labels of at most ``n`` vectors. Vectors at the threshold's
    angle agree in a bit with probability 1 - angle / pi; closer ones more often."""
    bits = min(60, max(LEAST_BITS, (max(n, 1) - 1).bit_length() + SPARE_BITS))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def planes(dim: int, bits: int, tables: int):
    import numpy as np

    return np.random.RandomState(SEED + dim).standard_normal((dim, bits * tables))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links,
    component_id, kept.

    Equal vectors of a label are one class, so copies are never paired. A class
    has one bucket per table, by the signs of its products with random planes; bits and
    tables follow from the largest label, see ``code_size``. A
    bucket is cut into tiles of bounded size, each pair of tiles is one matrix
    product in double precision, and only sums of links and a spanning forest
    leave it. A pair counts in the first table in which it meets. All buckets are
    compared whole; pairs below ``threshold`` never link.

    Only vectors of equal label and length are compared. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without a label,
    link with nothing. Repeated rows are copies. A null vec_id takes no part: no
    links, null component, not kept. Other columns are ignored.
    """
    import numpy as np

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    classes = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = save(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = code_size(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, threshold)

    def signs(batches):
        import pyarrow as pa

        weights = 1 << np.arange(bits, dtype=np.int64)
        known: dict = {}
        for batch in batches:
            codes = []
            for cell in batch.column(1):
                v = cell.values.to_numpy()
                if v.size not in known:
                    known[v.size] = planes(v.size, bits, tables)
                codes.append((v / np.abs(v).max() @ known[v.size] > 0).reshape(tables, bits) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["cid", "codes"])

    codes = save(classes.select("cid", "embedding").mapInArrow(signs, "cid long, codes array<long>"), "codes")
    member = classes.select("cid", "label", F.size("embedding").alias("dim")).join(codes, "cid")
    member = member.select("cid", "label", "dim", F.posexplode("codes").alias("t", "code"))
    bucket = ["label", "dim", "t", "code"]
    sizes = save(member.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / tile).cast("int")), "buckets")
    placed = member.join(sizes, bucket).withColumn("part", F.pmod(F.xxhash64("cid", "t"), F.col("parts")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("cid", "t", *[F.col(c).alias("b_" + c) for c in ("label", "dim", "code")], "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    full = tiles.join(classes.select("cid", "embedding", "copies"), "cid").join(codes, "cid")

    def compare(group):
        import pyarrow as pa

        cid, part = group.column("cid").to_numpy(), group.column("part").to_numpy()
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        order = np.argsort(cid, kind="stable")
        cid, part = cid[order], part[order]
        flat = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)[order]
        own = group.column("codes").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)[order]
        copies = group.column("copies").to_numpy()[order]
        flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow
        flat /= np.sqrt((flat * flat).sum(axis=1, keepdims=True))
        linked = flat @ flat.T >= threshold
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= part[:, None] != part[None, :]
        for before in range(t):
            linked &= own[:, None, before] != own[None, :, before]
        some = np.flatnonzero(linked.any(axis=1))
        linked = linked[np.ix_(some, some)]
        root = np.arange(some.size)
        while some.size:
            least = np.minimum(root, np.where(linked, root[None, :], some.size).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        links = linked @ copies[some]
        return pa.table({"cid": cid[some], "n": links.astype(np.int64), "root": cid[some][root] if some.size else cid[:0]})

    found = save(full.groupBy("b_label", "b_dim", "t", "b_code", "i", "j").applyInArrow(compare, "cid long, n long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "component")
    known = classes.select("cid", "rep", "copies", "label", "embedding").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = save(known.join(least, "component").join(links, "cid", "left").select("label", "embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-results")
    out = rows.where("valid").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_hyperplane_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
