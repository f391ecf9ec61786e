"""Line de-duplication by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import merge_blocks, quoted, references, save, table

#: Lines within so many edits of each other are near copies.
THRESHOLD = 2
#: Shorter lines (headings, list marks) have no near copies.
MIN_CHARS = 24
#: Lines from this length on have exact copies, unless they are blank.
EXACT_CHARS = 1
#: Keys or lines up to so many are matched by a broadcast, beyond by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Letters that are counted before lines are compared: an edit moves two counts by one
#: at most, so lines whose counts differ by more are not near.
TALLIED = ("a", "e", "i", "no", "ts", "rd", "hl", "uc")


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(start from 0, length) of the i-th of ``parts`` near-even segments."""
    size, extra = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts))
    longer = F.greatest(F.lit(0), F.lit(i - parts) + extra)
    return size * i + longer, size + F.when(extra >= parts - i, 1).otherwise(0)


def segment_keys(line: Column, length: Column, threshold: int = THRESHOLD) -> Column:
    """Keys under which a line meets every line at most ``threshold`` edits away.

    Of threshold + 1 segments of a line at least one stands unchanged in such a
    partner, near its own place. A line's keys are its segments and, for each length
    not above its own, the substrings at the places where such a segment can be
    (left and right neighbours leave no other); a key holds length and number.
    """
    parts, keys = threshold + 1, []
    for short in range(threshold + 1):
        target = length - short
        for i in range(parts):
            start, size = segment(target, i, parts)
            for shift in range(max(-i, short - threshold + i), min(i, short + threshold - i) + 1):
                keys.append(F.xxhash64(target, F.lit(i), F.substring(line, start + shift + 1, size)))
    return F.array_distinct(F.array(*keys))


def band_keys(line: Column, size: Column, low: Column, threshold: int = THRESHOLD) -> Column:
    """Keys under which a line of ``size`` characters meets every line at most
    ``threshold`` edits away that has keys for ``low`` too; fewer and wider than
    ``segment_keys``.

    threshold + 1 segments of low / (threshold + 1) characters are laid from both ends:
    the front half of them from the start, the others from the end. Of either the
    front ones or the back ones, more are there than edits fall into them, so an
    unchanged one has been moved by at most as many places as segments lie between it
    and its end of the line, i. The i + 1 windows of i characters less that lie within
    a segment then hold one in each line with the same content.
    """
    parts, keys = threshold + 1, []
    width = F.floor(low / parts).cast("int")
    front = (parts + 1) // 2
    for k in range(parts):
        i = k if k < front else parts - 1 - k
        start = width * k if k < front else size - width * (i + 1)
        keys += [F.xxhash64(low, F.lit(k), F.substring(line, start + shift + 1, F.greatest(width - i, F.lit(0)))) for shift in range(i + 1)]
    return F.array(*keys)


def band(size: Column, threshold: int = THRESHOLD) -> Column:
    """The least length of the band of lengths that ``size`` is in. There are four
    bands between powers of two, each at least threshold + 1 wide."""
    step = F.greatest(F.length(F.bin(size)) - 3, F.lit(threshold.bit_length()))
    return size - F.pmod(size, F.call_function("shiftleft", F.lit(1), step))


def _banded(lines: DataFrame, threshold: int) -> DataFrame:
    """(line, key): the ``band_keys`` of each line for its own length's band, and for
    the band below if lines shorter by ``threshold`` are in that one."""
    sized = lines.select("line", F.char_length("line").alias("size"))
    sized = sized.select("line", "size", band(F.col("size"), threshold).alias("low"), band(F.col("size") - threshold, threshold).alias("lower"))
    keys = band_keys(F.col("line"), F.col("size"), F.col("low"), threshold)
    below = F.when(F.col("lower") < F.col("low"), band_keys(F.col("line"), F.col("size"), F.col("lower"), threshold)).otherwise(F.array().cast("array<bigint>"))
    return sized.select("line", keys.alias("keys"), below.alias("below")).select("line", F.explode(F.concat("keys", "below")).alias("key"))


def common_run(a: Column, x: Column, b: Column, y: Column) -> Column:
    """How many characters ``a`` from x on and ``b`` from y on have in common, by halving."""
    rest = F.least(F.char_length(a) - x, F.char_length(b) - y)
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)
    same = lambda n, k: (n + power(k) <= rest) & (F.substring(a, x + n + 1, power(k)) == F.substring(b, y + n + 1, power(k)))
    steps = F.sequence(F.length(F.bin(F.greatest(rest, F.lit(0)))) - 1, F.lit(0), F.lit(-1))
    return F.aggregate(steps, F.lit(0), lambda n, k: n + F.when(same(n, k), power(k)).otherwise(F.lit(0)))


def _cut(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b, x, y)`` without the beginning and the end that x and y share; the
    edits between x and y stay the same."""
    for _ in range(2):  # the end is the beginning of the reversed lines
        pairs = pairs.withColumn("n", common_run(F.col("x"), F.lit(0), F.col("y"), F.lit(0)))
        pairs = pairs.select("a", "b", *[F.reverse(F.substring(c, F.col("n") + 1, F.char_length(c))).alias(c) for c in ("x", "y")])
    return pairs


def edit_places(line: Column, other: Column, threshold: int) -> list:
    """Steps of (name, column) that make ``places_0`` to ``places_<threshold>``: the
    places (x in the line, y in the other line) that are reached with so many edits at
    most, each as late as can be. Where both lines end, y is one above the length."""
    m, n = F.char_length(line), F.char_length(other)

    def reached(x: Column, y: Column) -> Column:
        run = common_run(line, x, other, y)
        return F.transform(F.array(run), lambda r: F.struct((x + r).alias("x"), (y + r + F.when((x + r == m) & (y + r == n), 1).otherwise(0)).alias("y")))[0]

    steps = [("places_0", F.array(reached(F.lit(0), F.lit(0))))]
    for k in range(1, threshold + 1):
        open_ = F.filter(F.col(f"places_{k - 1}"), lambda p: p["y"] <= n)
        next_ = lambda p: F.array(F.struct((p["x"] + 1).alias("x"), (p["y"] + 1).alias("y")), F.struct((p["x"] + 1).alias("x"), p["y"].alias("y")), F.struct(p["x"].alias("x"), (p["y"] + 1).alias("y")))
        inside = F.filter(F.flatten(F.transform(open_, next_)), lambda p: (p["x"] <= m) & (p["y"] <= n))
        steps.append((f"places_{k}", F.array_distinct(F.transform(F.array_distinct(inside), lambda p: reached(p["x"], p["y"])))))
    return steps


def edit_keys(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``lines(node, ref, line, ref_line)`` to finer blocks (key, node, tag).

    Two lines within ``threshold`` edits are both compared with a third one, the
    reference, from their beginning. Where the first of them departs from it while the
    other one follows it on, one of the edits between them must stand; after that edit
    the first goes on along the other. So, edit by edit, they come to a place of the
    reference that both reach with ``threshold`` edits together. The same holds from
    the end. A key is the reference and such a place; a tag holds the edits to get
    there and the places reached from the end.
    """
    for side in ("front", "rear"):
        if side == "rear":
            lines = lines.withColumns({"line": F.reverse("line"), "ref_line": F.reverse("ref_line")})
        for name, column in edit_places(F.col("line"), F.col("ref_line"), threshold):
            lines = lines.withColumn(name, column)
        known, found = F.array().cast("array<int>"), []
        for k in range(threshold + 1):
            ys = F.array_distinct(F.transform(F.col(f"places_{k}"), lambda p: p["y"]))
            edits = F.lit(k).alias("e")
            found.append(F.transform(F.array_except(ys, known), lambda y: F.struct(y.alias("y"), edits)))  # noqa: B023
            known = F.concat(known, ys)
        lines = lines.withColumn(side, F.concat(*found)).drop(*[f"places_{k}" for k in range(threshold + 1)])
    rear = F.transform("rear", lambda p: p["y"])
    keyed = lines.select("node", "ref", rear.alias("rear"), F.explode("front").alias("p"))
    return keyed.select(F.xxhash64("ref", "p.y").alias("key"), "node", F.struct("p.e", "rear").alias("tag"))


def within_edits(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether the edit distance of ``a`` and ``b`` is at most ``threshold``, by a
    banded bit-parallel recurrence (after Myers and Hyyro). ``a`` must not be longer.

    A column of the distance matrix is held for the 2 * threshold + 1 rows around
    the diagonal, as bits: vp and vn say where a value is one above or below the
    value over it. A step makes d0, where a value equals its upper left
    neighbour's; the final cell's distance is counted along its diagonal.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    codes = lambda x: F.transform(F.split(x, ""), lambda c: F.ascii(c))
    apart = F.char_length(b) - F.char_length(a)

    def matches(row: Column, column: Column) -> Column:
        at = lambda j: sum((F.when(F.get(row, j - threshold + r) == F.get(column, j), F.lit(1 << r)).otherwise(F.lit(0)) for r in range(width)), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.size(column) - 1), lambda j: F.struct(at(j).cast("long").alias("m"), j.alias("j")))

    start = F.struct(F.lit(mask & (mask << threshold)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), apart.cast("long").alias("d"), apart.alias("apart"))

    def step(s: Column, x: Column) -> Column:
        vp, vn, m, off = s["vp"], s["vn"], x["m"], s["apart"]
        d0 = (((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn)).bitwiseAND(F.lit(mask))
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        own = F.getbit(d0, F.lit(threshold) - off).cast("long")
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(mask)).alias("vp"),
            down.bitwiseAND(hp).bitwiseAND(F.lit(mask)).alias("vn"),
            (s["d"] + F.when(x["j"] >= off, F.lit(1).cast("long") - own).otherwise(F.lit(0).cast("long"))).alias("d"),
            off.alias("apart"),
        )

    pair = F.struct(codes(a).alias("a"), codes(b).alias("b"))
    steps = F.flatten(F.transform(F.array(pair), lambda p: matches(p["a"], p["b"])))
    return F.when((apart >= 0) & (apart <= threshold), F.aggregate(steps, start, step)["d"] <= threshold).otherwise(F.lit(False))


def _occurrences(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where((F.char_length("line") >= min_chars) | ((F.char_length("line") >= exact_chars) & F.col("line").rlike(r"\S")))


def _near_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """(digest, component) of the distinct lines of ``lines(line)`` that have a near copy."""
    small = lambda df: df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    keyed = _banded(lines, threshold)
    ends = keyed.select("key", F.xxhash64("line").alias("id")).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = save(ends.where("lo <> hi").select("key"), "shared-keys")
    if small(shared):
        found = keyed.join(F.broadcast(shared), "key")
    else:
        ids = save(keyed.select("key", F.xxhash64("line").alias("id")).join(shared, "key").select("id").distinct(), "line-ids")
        found = lines.select("line", F.xxhash64("line").alias("id")).join(F.broadcast(ids) if small(ids) else ids, "id")
    found = found.select("line", F.unhex(F.md5("line")).alias("digest")).groupBy("digest").agg(F.first("line").alias("line"))
    known = save(found.withColumns({"node": F.monotonically_increasing_id(), "size": F.char_length("line")}), "lines")

    posted = save(known.select("node", "size", F.explode(segment_keys(F.col("line"), F.col("size"), threshold)).alias("key")), "line-keys")
    met = save(posted.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "met-keys")
    posted = save(posted.join(F.broadcast(met) if small(met) else met, "key"), "line-postings")
    sizes = known.select(F.col("node").alias("lead"), F.col("size").alias("lead_size"))

    tally = lambda line: F.array(*[F.char_length(line) - F.char_length(F.translate(line, letters, "")) for letters in TALLIED])
    moved = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)

    def verified(pairs: DataFrame) -> DataFrame:
        text = lambda name: known.select(F.col("node").alias(name), F.col("line").alias("t" + name))
        both = pairs.join(text("a"), "a").join(text("b"), "b")
        swap = F.char_length("ta") > F.char_length("tb")
        both = both.select("a", "b", F.when(swap, F.col("tb")).otherwise(F.col("ta")).alias("x"), F.when(swap, F.col("ta")).otherwise(F.col("tb")).alias("y"))
        both = save(_cut(both), "cut-pairs")  # a filter over the cuts would repeat their expressions
        both = save(both.where(moved(tally("x"), tally("y")) <= 2 * threshold), "near-pairs")
        return save(both.where(within_edits(F.col("x"), F.col("y"), threshold)).select("a", "b"), "line-links")

    leads = posted.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").join(sizes, "lead").select("key", "lead", "lead_size")
    first = posted.join(leads, "key").where((F.col("lead") < F.col("node")) & (F.abs(F.col("size") - F.col("lead_size")) <= threshold))
    links = verified(first.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    fits = (F.abs(F.col("size") - F.col("o_size")) <= threshold) & (moved("tally", "o_tally") <= 2 * threshold)
    attributes = lambda nodes: known.join(nodes, "node", "left_semi").select("node", "size", tally("line").alias("tally"))

    def split(refs: DataFrame):
        pairs = save(refs.where("node <> ref").select("node", "ref").distinct(), "references")
        star = verified(pairs.select(F.least("node", "ref").alias("a"), F.greatest("node", "ref").alias("b")))
        both = pairs.join(known.select("node", "line"), "node").join(known.select(F.col("node").alias("ref"), F.col("line").alias("ref_line")), "ref")
        return save(edit_keys(both, threshold), "edit-keys"), star

    meets = lambda tag, o: (tag["e"] + o["e"] <= threshold) & F.arrays_overlap(tag["rear"], o["rear"])
    comp = merge_blocks(posted, links, verified, attributes, ("size", "tally"), fits, references, split, meets)
    return comp.join(known.select("node", "digest"), "node").select("digest", "component")


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = EXACT_CHARS) -> DataFrame:
    """``docs`` with ``text`` reduced to lines that don't repeat an earlier one, and
    n_lines, n_exact and n_near: lines it had, and lines dropped as exact and as near
    copies. One row per row of ``docs``; its other columns stay.

    Lines (between newlines) of at least ``min_chars`` characters are one class if
    equal or joined by pairs within ``threshold`` edits. Of a class the first line
    stays, by doc_id and place, over all documents. Of shorter lines, those that are
    not blank and have at least ``exact_chars`` characters are one class if equal; all
    others (with None every shorter line) always stay.

    Lines that no other meets under ``band_keys`` have no near copies. For the rest,
    pairs are found under the keys of ``segment_keys``: each line with the least line
    under a key, then, under keys whose lines are still in different components,
    those across; many lines under one key are first split by ``edit_keys``. Copies
    are one line throughout, so their groups are never paired.

    A null text stays null and has 0 lines; an empty one has 1 line and stays; rows
    with a null doc_id stay as they are; rows with equal doc_id and text are one
    document; a line may be as long as its text. Columns called n_lines, n_exact or n_near
    are replaced, other names are free.
    """
    if min_chars <= 2 * threshold + 1:
        raise ValueError("min_chars must exceed 2 * threshold + 1")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    docs = docs.select(*[quoted(c) for c in keep])
    lines = _occurrences(docs.select("doc_id", "text"), min_chars, min_chars if exact_chars is None else exact_chars)
    placed = lines.select(F.unhex(F.md5("line")).alias("digest"), F.struct("doc_id", "version", "no").alias("at"))
    first = save(placed.groupBy("digest").agg(F.min("at").alias("at"), F.count("*").alias("n")), "first-lines")
    near = save(_near_lines(lines.where(F.char_length("line") >= min_chars).select("line"), threshold), "near-lines")
    of_class = near.join(first, "digest").groupBy("component").agg(F.min("at").alias("keep"))
    target = near.join(of_class, "component").select("digest", "keep")
    plain = first.where("n > 1").join(near.select("digest"), "digest", "left_anti").select("digest", F.col("at").alias("keep"))
    target = save(target.unionAll(plain).join(first.select("digest", F.col("at").alias("own")), "digest"), "kept-lines")
    dropped = placed.join(target, "digest").where("at <> keep").select("at.doc_id", "at.version", "at.no", (F.col("at") == F.col("own")).alias("near"))
    dropped = dropped.groupBy("doc_id", "version").agg(F.collect_set("no").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("no"))).alias("near"))
    dropped = dropped.toDF("of_doc", "of_version", "gone", "near")
    rows = docs.select(F.struct(*[quoted(c) for c in keep]).alias("row"))
    own = {c: F.col("row").getField(c) for c in keep}
    out = rows.join(dropped, (own["doc_id"] == F.col("of_doc")) & (F.xxhash64(own["text"]) == F.col("of_version")), "left")
    out = out.select("row", "gone", "near", F.split(own["text"], "\n").alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i))
    n_gone, n_near = (F.greatest(F.coalesce(F.size(c), F.lit(0)).cast("long"), F.lit(0)) for c in ("gone", "near"))
    own["text"] = F.when(F.col("gone").isNull(), own["text"]).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return out.select(*[c.alias(name) for name, c in own.items()], n_lines.alias("n_lines"), (n_gone - n_near).alias("n_exact"), n_near.alias("n_near"))


def op9_segment_edit_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_exact") - F.col("n_near")).alias("n_kept"), "n_exact", "n_near", F.sha2("text", 256).alias("text_sha256"))


#: Edits are counted on bytes by this function, so letters outside ASCII are first
#: mapped to single bytes.
OP9_SQL = """
WITH RECURSIVE o AS (
  SELECT doc_id, i - 1 AS no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)),
u AS (
  SELECT line, min(struct_pack(d := doc_id, n := no)) AS at, length(line) AS len,
         translate(line, 'àáâäçèéêëíîïñóôöùúûüßÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(11)||chr(12)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)||chr(27)||chr(28)||chr(29)||chr(30)||chr(31)||'QWYXZJKVPFG{}~^`<>') AS k
  FROM o WHERE length(line) >= 24 OR regexp_matches(line, '\\S') GROUP BY line),
pairs AS (SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON a.len >= 24 AND b.len >= 24 AND b.len BETWEEN a.len - 2 AND a.len + 2 AND a.line <> b.line WHERE levenshtein(a.k, b.k) <= 2),
reach AS (SELECT line AS a, line AS b FROM u WHERE line IN (SELECT a FROM pairs) UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
keepers AS (SELECT a AS line, min(u.at) AS keep FROM reach JOIN u ON u.line = reach.b GROUP BY a),
j AS (
  SELECT o.doc_id, o.no, o.line, struct_pack(d := o.doc_id, n := o.no) AS here, u.at AS own, coalesce(k.keep, u.at) AS keep
  FROM o LEFT JOIN u ON o.line = u.line LEFT JOIN keepers k ON k.line = u.line)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (keep IS NULL OR here = keep) AS n_kept,
       count(*) FILTER (keep IS NOT NULL AND here <> keep AND here <> own) AS n_exact,
       count(*) FILTER (keep IS NOT NULL AND here <> keep AND here = own) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (keep IS NULL OR here = keep), '')) AS text_sha256
FROM j GROUP BY doc_id
"""
