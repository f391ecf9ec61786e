"""Helpers shared by the text operators: inputs, the shared folder, connected components."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.tables import discard, save, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> F.Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(df: DataFrame) -> F.Column:
    """All columns of ``df`` as one struct, so that no name clashes with another's."""
    return F.struct(*[quoted(c) for c in df.columns])


def packed(numbers, kind="int32") -> bytes:
    """Bytes of an array of one type, compressed."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.asarray(numbers, kind).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind="int32"):
    import numpy as np
    import pyarrow as pa

    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(data, decompressed_size=kind.itemsize * size, codec="zstd"), kind)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, the
    component being its smallest node. Nodes without an edge are not returned.

    Each round every node points to its smallest neighbour if that is smaller
    than itself; pointers are followed to their roots by doubling; edges are then
    drawn between roots. Local minima are at most half of a component's nodes, so
    the graph at least halves in a round. All steps are joins and partial
    aggregates on edges; nothing is collected but counts.
    """
    edges = save(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct(),
        "edges",
    )
    result = None
    for left in range(max_rounds, -1, -1):
        if edges.isEmpty():
            break
        if not left:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = save(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")),
            "pointers",
        )
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("up"))
            step = save(point.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")), "pointers")
            point = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        edges = save(
            edges.join(point.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(point.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
        if result is None:
            result = point
        else:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("up"))
            result = save(result.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return result.select("node", F.col("root").alias("component"))


#: Blocks up to this size are paired as they are, larger ones are first split.
SMALL_BLOCK = 16
#: Splitting goes on while it leaves at most this share of the pairs in large blocks.
SHRINK = 0.75
#: Finer blocks with sides are paired without a further splitting if that compares at most
#: so many times as many pairs as the blocks had members at first.
FEW_PAIRS = 32


def references(large: DataFrame, level: int = 0, first: bool = True) -> DataFrame:
    """(key, node, ref): a node that the members of a block are all compared with, from
    ``large(key, node)``. Of the first members of the blocks that a block's members are
    in, it is the first, so that blocks of much the same members have the same. The
    order is that of the nodes, and on later levels a shuffled one of the level's own."""
    order = F.struct((F.xxhash64("node", F.lit(level)) if level else F.col("node")).alias("place"), "node")
    return _references(large, order)


def _references(large: DataFrame, order: F.Column) -> DataFrame:
    least = large.groupBy("key").agg(F.min(order).alias("lead"))
    of_node = large.join(least, "key").groupBy("node").agg(F.min("lead").alias("lead"))
    of_key = large.join(of_node, "node").groupBy("key").agg(F.min("lead")["node"].alias("ref"))
    return large.select("key", "node").join(of_key, "key")


def central_references(large: DataFrame, level: int = 0, first: bool = True) -> DataFrame:
    """As ``references``, but where ``first`` those come first that meet the most others in
    their blocks: of the copies of one text the ones with the fewest changes of their own."""
    if not first:
        return references(large, level)
    size = large.groupBy("key").agg(F.count("*").alias("size"))
    place = large.join(size, "key").groupBy("node").agg((-F.sum("size")).alias("place"))
    return _references(large.join(place, "node"), F.struct("place", "node"))


def merge_blocks(posted: DataFrame, links: DataFrame, verified, attributes, facts: tuple[str, ...], fits, choose, split, meets) -> DataFrame:
    """Components of all links between nodes that share a block, from ``links(a, b)``
    that are known already. ``posted(key, node)`` lists the blocks' members and
    ``verified`` keeps the linking rows of a frame of pairs (a, b). ``attributes`` gives
    for a frame of nodes (node, *facts); ``fits`` is a condition on these columns, and on
    those of the other node with o_ before their names, that holds for every pair that
    links.

    Only pairs across components matter, so blocks of one component drop out. Members of
    large blocks first meet one of them, a new one in each round, as long as the links
    found there make the blocks that are left smaller: so a group of near copies becomes
    one component without being paired. Then small blocks are paired and large ones are
    split against a reference with which their members are all compared. ``split(refs)``
    takes (key, node, ref) and gives finer blocks (key, node, tag), without the
    references, and the links to references: two nodes of one large block that link, and
    that these links don't join, share a finer block in which ``meets(tag, other's tag)``
    holds. What is left is treated the same way again, and no link is missed. Blocks
    that no longer get smaller are paired at last, across components only. Finer blocks
    may have a column ``side``: members of side 0 are paired with each other, in blocks of
    their own, those of side 1 with those of side 2 and with none else. ``central`` is for
    ``references``, where members first meet one and where blocks are split.
    """
    comp, level, turn, before, at_split = components(links), 0, 0, None, None
    at_first = posted.count()
    while True:
        tag = [c for c in ("tag", "side") if c in posted.columns] if level else []
        named = posted.select("key", "node", *tag).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sides = [F.count_if(F.col("side") < 2).alias("l"), F.count_if(F.col("side") != 1).alias("r")] if "side" in tag else []
        by = named.groupBy("key", "component").agg(F.count("*").alias("m"), *sides).groupBy("key")
        by = by.agg(F.sum("m").alias("members"), F.count("*").alias("parts"), (F.sum("l") * F.sum("r") if sides else F.sum("m") * F.sum("m")).alias("pairs"))
        mixed = save(named.join(by.where("parts > 1").select("key", "members", "pairs"), "key"), "mixed-blocks")
        large = mixed.where(F.col("members") > SMALL_BLOCK).select("key", "node", "component")
        volume, pairs = mixed.where(F.col("members") > SMALL_BLOCK).agg(F.sum("members"), F.sum(F.col("pairs") / F.col("members"))).first()
        volume, few = volume or 0, bool(sides) and (pairs or 0) <= FEW_PAIRS * at_first
        turn += 1
        last = False
        if volume and not few and (before is None or volume <= SHRINK * before):
            refs = choose(large.select("key", "node"), turn, before is None)
            of = large.select("key", F.col("node").alias("ref"), F.col("component").alias("of"))
            met = refs.join(large, ["key", "node"]).join(of, ["key", "ref"]).where("component <> of")
            pairs = save(met.select(F.least("node", "ref").alias("a"), F.greatest("node", "ref").alias("b")).distinct(), "stars")
            found, before = [verified(pairs)], volume
            discard(mixed)
        else:
            last = not volume or few or at_split is not None and volume > SHRINK * at_split
            left = save(mixed.join(attributes(mixed.select("node").distinct()), "node").select("key", "node", "component", (F.lit(not last) & (F.col("members") > SMALL_BLOCK)).alias("large"), *tag, *facts), "mixed-blocks")
            small = left.where("not large")
            other = small.select("key", F.col("node").alias("o"), F.col("component").alias("o_component"), *[F.col(c).alias("o_" + c) for c in [*tag, *facts]])
            order = F.col("node") < F.col("o")
            if "side" in tag:
                small, other, order = small.where("side < 2"), other.where("o_side <> 1"), order | (F.col("side") == 1)
            apart = order & (F.col("component") != F.col("o_component")) & fits
            if level:
                apart = apart & meets(F.col("tag"), F.col("o_tag"))
            pairs = save(small.drop("large").join(other, "key").where(apart).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct(), "apart")
            found = [] if pairs.isEmpty() else [verified(pairs)]
            if not last:
                refs = save(choose(left.where("large").select("key", "node"), turn), "references")
                posted, more = split(refs)
                found.append(more)
                level, at_split, before = level + 1, volume, None
            discard(mixed, left, pairs)
        if found:
            known = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = components(functools.reduce(DataFrame.unionAll, found, known))
        if last:
            return comp
