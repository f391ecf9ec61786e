"""Phrase collocations: SETM over sorted occurrence relations (Houtsma and Swami 1995).

An occurrence relation holds (place, group) in order of place. Places number the words
of a block of texts, and a piece's end takes up a place of its own, so that places that
follow each other are neighbours within one piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed, save, table, unpacked

#: A block takes texts until they have so many bytes.
BLOCK_BYTES = 8 << 20
MAX_WORDS, SUPPORT, SHARE, TOP = 3, 10, 50, 2000
#: What ends a piece; tabs part words as spaces do.
ENDS = b".,;:!?\n\x0b\x0c\r"
TO_MARKS = bytes(10 if c in ENDS else 32 if c == 9 else c for c in range(256))


class Numbers(dict):
    """Words of one language -> codes of a block; ends of pieces are -1, nothing is -2."""

    def __init__(self, lang: str, names: list):
        super().__init__({b"\n": -1, b"": -2})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return code


def occurrences(docs: DataFrame) -> DataFrame:
    """The stored relation of single words, a row per block: steps between the ``place`` of
    all its ``size`` words and their ``code``, packed, and the language, word and count of
    each code."""
    import numpy as np

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0

        def flush():
            codes = np.concatenate(found)
            place = np.flatnonzero(codes >= 0).astype(np.int32)
            codes = codes[place]
            langs, words = [n[0] for n in names], pa.array([n[1] for n in names], pa.binary()).cast(pa.string())
            count = np.bincount(codes, minlength=len(names))
            columns = [pa.array([(task << 32) + seq]), pa.array([len(place)], pa.int64()), pa.array([packed(np.diff(place, prepend=0))]), pa.array([packed(codes)])]
            lists = [pa.ListArray.from_arrays([0, len(names)], a) for a in (pa.array(langs, pa.string()), words, pa.array(count, pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=["block", "size", "place", "code", "lang", "word", "f"])

        found, names, by_lang, held = [], [], {}, 0
        for batch in batches:
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number = by_lang.get(lang)
                if number is None:
                    number = by_lang[lang] = Numbers(lang, names)
                text = cell.as_py()
                marks = text.lower().translate(TO_MARKS).replace(b"\n", b" \n ").split(b" ")
                codes = np.fromiter(map(number.__getitem__, marks), np.int32, len(marks))
                found += [codes[codes > -2], np.array([-1], np.int32)]
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield flush()
                    found, names, by_lang, held = [], [], {}, 0
                    seq += 1
        if found:
            yield flush()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("string").cast("binary").alias("text"))
    return save(texts.mapInArrow(blocks, "block long, size long, place binary, code binary, lang array<string>, word array<string>, f array<long>"), "occurrences")


def extended(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """The stored relation one word longer. ``relation(block, size, place, code)`` keeps what is
    in ``frequent``, rows of (block, code, id) or, packed, (block, n, codes, ids); it is merged with itself where one place follows
    the other. A row per block: place and code as before, and for each code the ids of
    its groups without the last word (``left``) and without the first (``right``)."""
    import numpy as np

    def merge(key, own, kept):
        import pyarrow as pa

        out = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("place", pa.binary()), ("code", pa.binary()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])
        if not own.num_rows or not kept.num_rows:
            return out.empty_table()
        size = own.column("size")[0].as_py()
        if not size:
            return out.empty_table()
        place, code = np.cumsum(unpacked(own.column("place")[0].as_py(), size), dtype=np.int32), unpacked(own.column("code")[0].as_py(), size)
        if "ids" in kept.column_names:
            cells = list(zip(*(kept.column(c).to_pylist() for c in ("n", "codes", "ids")), strict=True))
            codes, ids = np.concatenate([np.cumsum(unpacked(c, n), dtype=np.int64) for n, c, _ in cells]), np.concatenate([planes_read(i, n) for n, _, i in cells])
        else:
            codes, ids = kept.column("code").to_numpy(), kept.column("id").to_numpy()
        order = np.argsort(ids)
        codes, ids = codes[order], ids[order]
        local = np.full(max(int(code.max()), int(codes.max())) + 1, -1, np.int64)
        local[codes] = np.arange(len(ids))
        group = local[code]
        stays = group >= 0
        place, group = place[stays], group[stays]
        at = np.flatnonzero(place[1:] == place[:-1] + 1)
        pairs, code, count = np.unique(group[at] * len(ids) + group[at + 1], return_inverse=True, return_counts=True)
        cells = [[key[0].as_py()], [len(at)], [packed(np.diff(place[at], prepend=0))], [packed(code)], [ids[pairs // len(ids)]], [ids[pairs % len(ids)]], [count]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cells, out, strict=True)], schema=out)

    both = relation.select("block", "size", "place", "code").groupBy("block").cogroup(frequent.withColumnRenamed("block", "of").groupBy("of"))
    return save(both.applyInArrow(merge, "block long, size long, place binary, code binary, left array<long>, right array<long>, f array<long>"), "occurrences")


def groups_of(relation: DataFrame, *names: str) -> DataFrame:
    """(block, code, *names, f): the groups of each block with their counts there."""
    return relation.select("block", F.posexplode(F.arrays_zip(*names, "f")).alias("code", "g")).select("block", "code", *[f"g.{c}" for c in names], "g.f")


def frequent_groups(spread: DataFrame, keys: list[str], support: int) -> DataFrame:
    """The stored rows (block, code, id, head, *keys, a) of ``spread(block, code, *keys, f)``
    whose groups occur ``support`` times in all blocks. A group's rows have one id, and
    one of them, its head, has the keys and the count ``a``. One shuffle counts the groups
    and keeps the frequent ones' places; a group has no more rows than there are blocks."""
    group = Window.partitionBy(*keys)
    d = spread.repartition(*keys).withColumn("row", F.monotonically_increasing_id())
    d = d.withColumns({"a": F.sum("f").over(group), "id": F.min("row").over(group)}).where(F.col("a") >= support)
    head = F.col("row") == F.col("id")
    return save(d.select("block", "code", "id", head.alias("head"), *[F.when(head, F.col(c)).alias(c) for c in (*keys, "a")]), "groups")


def planes(numbers) -> bytes:
    """Longs by byte, all lowest bytes first, compressed."""
    import numpy as np

    return packed(np.ascontiguousarray(np.asarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T), np.uint8)


def planes_read(data: bytes, size: int):
    import numpy as np

    return np.ascontiguousarray(unpacked(data, 8 * size, np.uint8).reshape(8, size).T).view(np.int64).ravel()


def frequent_extended(relation: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """The groups of ``relation(block, left, right, f)`` that occur ``support`` times in all
    blocks: (id, left, right, a) of the groups, and (block, n, codes, ids), packed, of
    their places. A block's groups are dealt in packed form by a hash of (left, right),
    a row per block and share; a share's task counts its groups. Blocks keep groups in
    the order of left and right, so a packed row holds small steps."""
    import numpy as np

    shares = 1 << (2 * int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    def deal(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        names = ["share", "block", "n", "codes", "lefts", "rights", "fs"]
        for batch in batches:
            for k in range(batch.num_rows):
                left, right, f = (batch.column(c)[k].values.to_numpy() for c in (1, 2, 3))
                h = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.view(np.uint64)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                share = ((h ^ (h >> np.uint64(29))) % np.uint64(shares)).astype(np.int32)
                order = np.argsort(share, kind="stable")
                cuts = np.searchsorted(share[order], np.arange(shares + 1))
                rows = []
                for i in range(shares):
                    at = order[cuts[i] : cuts[i + 1]]
                    if at.size:
                        rows.append((i, batch.column(0)[k].as_py(), at.size, packed(np.diff(at, prepend=0)), planes(np.diff(left[at], prepend=0)), planes(right[at]), planes(f[at])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def count(dealt):
        import pyarrow as pa

        out = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary()), ("id", pa.list_(pa.int64())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("a", pa.list_(pa.int64()))])
        size = dealt.column("n").to_numpy()
        lefts, rights, fs = (dealt.column(c).to_pylist() for c in ("lefts", "rights", "fs"))
        left = np.concatenate([np.cumsum(planes_read(x, n)) for x, n in zip(lefts, size, strict=True)])
        right, f = (np.concatenate([planes_read(x, n) for x, n in zip(cells, size, strict=True)]) for cells in (rights, fs))
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(f[order], first)
        stays = total >= support
        number = np.where(stays, (dealt.column("share")[0].as_py() << 40) + np.cumsum(stays) - 1, -1)
        ids = np.empty(len(order), np.int64)
        ids[order] = number[np.cumsum(new) - 1]
        rows, end = [], np.cumsum(size)
        for block, codes, n, e in zip(dealt.column("block").to_pylist(), dealt.column("codes").to_pylist(), size, end, strict=True):
            own = ids[e - n : e]
            kept = own >= 0
            if kept.any():
                code = np.cumsum(unpacked(codes, n), dtype=np.int64)[kept]
                rows.append((block, int(kept.sum()), packed(np.diff(code, prepend=0)), planes(own[kept]), None, None, None, None))
        if stays.any():
            rows.append((None, None, None, None, number[stays], left[first][stays], right[first][stays], total[stays]))
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    dealt = relation.select("block", "left", "right", "f").mapInArrow(deal, "share int, block long, n long, codes binary, lefts binary, rights binary, fs binary")
    found = save(dealt.groupBy("share").applyInArrow(count, "block long, n long, codes binary, ids binary, id array<long>, left array<long>, right array<long>, a array<long>"), "groups")
    heads = found.where("block is null").select(F.explode(F.arrays_zip("id", "left", "right", "a")).alias("g")).select("g.*")
    return heads, found.where("block is not null").select("block", "n", "codes", "ids")


def best_cut(words: int) -> str:
    """SQL of the lowest-scoring cut (score, k, l, r) from the counts of a phrase's
    beginnings and endings, by number of words. Products are decimals of 38 digits,
    exact for counts below 10**15."""
    exact = "cast({} as decimal(15, 0))".format
    cuts = []
    for k in range(1, words):
        left, right = f"pre[{k - 1}]", f"suf[{words - k - 1}]"
        score = f"(cast(1000000 as decimal(7, 0)) * {exact('a')} * {exact('a')}) div ({exact(left)} * {exact(right)})"
        cuts.append(f"named_struct('score', {score}, 'k', {k}, 'l', {left}, 'r', {right})")
    return f"array_min(array({', '.join(cuts)}))"


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, support: int = SUPPORT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to
    ``max_words`` words of ``docs(text, lang)``.

    Relations of one, two, ... words are stored in blocks of texts. A block's distinct
    groups are counted there and summed over blocks; those that occur ``support`` times
    go back to the blocks, and only they are extended. So frequent words and
    pairs cost one row per block, and memory is that of a block, or of one text if that
    is longer. A phrase is left out if one that is a word longer occurs in at least
    ``share`` percent of its places; one that is longer still implies one of these.
    A null or empty text has no words, a null language is ``und``, repeated rows count
    each, equal scores are ordered by count and then bytes of the phrase.
    """
    relation = occurrences(docs)
    spread = groups_of(relation, "lang", "word")
    totals = spread.groupBy("lang").agg(F.sum("f").alias("n"))
    places = frequent_groups(spread, ["lang", "word"], support)
    one = F.array("a")
    level, levels = places.where("head").select("id", "lang", "word", F.col("word").alias("phrase"), "a", one.alias("pre"), one.alias("suf")), []
    places = places.select("block", "code", "id")
    for length in range(2, max_words + 1):
        relation = extended(relation, places)
        if length < max_words:
            counted, places = frequent_extended(relation, support)
        else:
            spread = groups_of(relation, "left", "right")
            counted = spread.groupBy("left", "right").agg(F.sum("f").alias("a")).where(F.col("a") >= support).withColumn("id", F.lit(None).cast("long"))
        left = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), F.col("pre").alias("pre_l"))
        right = level.select(F.col("id").alias("right"), F.col("word"), F.col("suf").alias("suf_r"))
        named = counted.join(left, "left").join(right, "right")
        level = save(
            named.select("id", "left", "right", "lang", "word", F.concat_ws(" ", "first", "word").alias("phrase"), "a", F.concat("pre_l", F.array("a")).alias("pre"), F.concat("suf_r", F.array("a")).alias("suf")),
            "levels",
        )
        levels.append((length, level))
    found = []
    for k, (length, level) in enumerate(levels):
        scored = level.withColumn("cut", F.expr(best_cut(length))).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        if k + 1 < len(levels):
            longer = levels[k + 1][1]
            within = longer.select(F.col("left").alias("id"), F.col("a").alias("b")).unionAll(longer.select(F.col("right").alias("id"), F.col("a").alias("b")))
            scored = scored.join(within.groupBy("id").agg(F.max("b").alias("b")), "id", "left").where(F.coalesce(100 * F.col("b") < share * F.col("a"), F.lit(True)))
        found.append(scored.select("lang", "phrase", "a", "l", "r", "score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are first ranked in parts, so no task gets all of them.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = every.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents) WHERE len(words) > 0),
occ AS (SELECT lang, piece, unnest(words) AS word, unnest(range(len(words))) AS pos FROM pieces),
next2 AS (
  SELECT lang, word AS w1, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM occ WINDOW p AS (PARTITION BY piece ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM next2 GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM next2 WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM next2 WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM occ GROUP BY lang),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT g.lang, g.w1 || ' ' || g.w2 AS phrase, g.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 g JOIN f1 x ON x.lang = g.lang AND x.w1 = g.w1 JOIN f1 y ON y.lang = g.lang AND y.w1 = g.w2
  LEFT JOIN longer o ON o.lang = g.lang AND o.w1 = g.w1 AND o.w2 = g.w2
  WHERE o.f IS NULL OR 100 * o.f < 50 * g.f
  UNION ALL
  SELECT g.lang, g.w1 || ' ' || g.w2 || ' ' || g.w3, g.f, 1, x.f, y.f
  FROM f3 g JOIN f1 x ON x.lang = g.lang AND x.w1 = g.w1 JOIN f2 y ON y.lang = g.lang AND y.w1 = g.w2 AND y.w2 = g.w3
  UNION ALL
  SELECT g.lang, g.w1 || ' ' || g.w2 || ' ' || g.w3, g.f, 2, x.f, y.f
  FROM f3 g JOIN f2 x ON x.lang = g.lang AND x.w1 = g.w1 AND x.w2 = g.w2 JOIN f1 y ON y.lang = g.lang AND y.w1 = g.w3),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, len(string_split(phrase, ' ')) ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""
