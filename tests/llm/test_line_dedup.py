"""Line de-duplication against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, line_dedup
from tidemark.llm.line_dedup import drop_repeated_lines, segment_keys, within_edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, text, edits, alphabet):
    text = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(text) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            text.insert(at, rnd.choice(alphabet))
        elif kind == 1 and at < len(text):
            del text[at]
        elif at < len(text):
            text[at] = rnd.choice(alphabet)
    return "".join(text)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_distance_and_keys(spark, threshold):
    rnd = random.Random(threshold)
    pairs = []
    for alphabet in ("ab", "abcé🙂. "):
        for _ in range(400):
            a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(10, 40)))
            pairs.append((a, edited(rnd, a, rnd.randint(0, 5), alphabet)))
    pairs = [(min(p, key=len), max(p, key=len)) for p in pairs]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within_edits(F.col("a"), F.col("b"), threshold).alias("near"), F.arrays_overlap(segment_keys(F.col("a"), F.char_length("a"), threshold), segment_keys(F.col("b"), F.char_length("b"), threshold)).alias("meet"))
    for r in frame.collect():
        want = distance(r.a, r.b) <= threshold
        assert r.near == want, (r.a, r.b)
        assert r.meet or not want, (r.a, r.b)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_bands_and_cuts(spark, threshold):
    rnd = random.Random(10 + threshold)
    pairs = []
    for alphabet in ("abcdefgh", "abcé🙂. "):
        for size in [*range(2 * threshold + 2, 40), 63, 64, 65, 95, 97, 127, 129]:
            for _ in range(3):
                a = "".join(rnd.choice(alphabet) for _ in range(size))
                pairs.append((a, edited(rnd, a, rnd.randint(1, threshold), alphabet)))
    pairs = [(k, min(p, key=len), max(p, key=len)) for k, p in enumerate(pairs) if min(map(len, p)) > 2 * threshold]
    frame = spark.createDataFrame(pairs, "k long, x string, y string")
    keys = lambda name: line_dedup._banded(frame.select(F.col(name).alias("line")), threshold).toDF(name, "key")
    met = {(r.x, r.y) for r in keys("x").join(keys("y"), "key").distinct().collect()}
    assert met >= {p[1:] for p in pairs}
    cut = line_dedup._cut(frame.select(F.col("k").alias("a"), F.col("k").alias("b"), "x", "y")).collect()
    assert sum(len(r.x) for r in cut) < sum(len(p[1]) for p in pairs)  # how much goes depends on where the edits lie
    for r in cut:
        assert distance(r.x, r.y) == distance(*pairs_of(pairs, r.a)), (r.x, r.y)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_keys_under_any_reference(spark, threshold):
    rnd = random.Random(20 + threshold)
    rows = []
    for k in range(300):
        alphabet = "ab" if k % 2 else "abcé🙂. "
        ref = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 24)))
        a = edited(rnd, ref, rnd.randint(0, 6), alphabet)
        rows.append((k, ref, a, edited(rnd, a, rnd.randint(0, threshold), alphabet)))
    frame = spark.createDataFrame(rows, "ref long, ref_line string, a string, b string")
    keys = lambda name: line_dedup.edit_keys(frame.select("ref", F.lit(0).alias("node"), F.col(name).alias("line"), "ref_line"), threshold)
    of = lambda name: keys(name).join(frame.select(F.col("ref").alias("k")).crossJoin(spark.range(-1, 40).toDF("y")).select(F.xxhash64("k", F.col("y").cast("int")).alias("key"), "k"), "key")
    a, b = of("a").select("key", "k", F.col("tag").alias("s")), of("b").select("key", "k", F.col("tag").alias("t"))
    met = {r.k for r in a.join(b, ["key", "k"]).where((F.col("s.e") + F.col("t.e") <= threshold) & F.arrays_overlap("s.rear", "t.rear")).select("k").distinct().collect()}
    assert met >= {k for k, _, a, b in rows if distance(a, b) <= threshold}


def pairs_of(pairs, k):
    return next(p[1:] for p in pairs if p[0] == k)


def brute(rows, threshold, least):
    places = {}
    for doc, text in rows:
        for no, line in enumerate(text.split("\n") if text is not None else []):
            if doc is not None and (len(line) >= least or line.strip()):
                places.setdefault(line, set()).add((doc, no))
    lines = list(places)
    comp = {x: x for x in lines}
    long = [x for x in lines if len(x) >= least]

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, x in enumerate(long):
        for y in long[:i]:
            if abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold:
                comp[root(x)] = root(y)
    keep = {}
    for x in lines:
        keep[root(x)] = min(keep.get(root(x), (10**9, 0)), min(places[x]))
    out = []
    for doc, text in rows:
        if text is None or doc is None:
            out.append((doc, text, 0 if text is None else text.count("\n") + 1, 0, 0))
            continue
        kept, exact, near = [], 0, 0
        for no, line in enumerate(text.split("\n")):
            if line not in places or keep[root(line)] == (doc, no):
                kept.append(line)
            elif min(places[line]) == (doc, no):
                near += 1
            else:
                exact += 1
        out.append((doc, "\n".join(kept), text.count("\n") + 1, exact, near))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("broadcast", "small", "shrink"), [(1_000_000, 16, 0.75), (0, 2, 0.75), (0, 2, 0.0)])
def test_against_all_pairs(spark, monkeypatch, broadcast, small, shrink):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(common, "SMALL_BLOCK", small)
    monkeypatch.setattr(common, "SHRINK", shrink)
    rnd = random.Random(9)
    alphabet = "abcdefgh éß"
    bases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(8, 60))) for _ in range(40)]
    chain = ["".join(rnd.choice(alphabet) for _ in range(30))]
    for k in range(8):  # near its neighbours only
        chain.append(chain[-1][: 3 * k] + "##" + chain[-1][3 * k + 2 :])
    rows = []
    for doc in range(60):
        rows.append((doc, "\n".join(edited(rnd, rnd.choice(bases + chain), rnd.choice([0, 0, 0, 1, 2, 3]), alphabet) for _ in range(rnd.randint(0, 8)))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, bases[0] + "\n" + bases[0]), (103, "x" * 900), (104, "y" + "x" * 899), (106, "z" * 90_000), (105, "\r\n" + bases[1] * 3 + "\r\n" + bases[1] * 3), rows[7], rows[7]]
    frame = spark.createDataFrame([(*r, 5, "s", "v") for r in rows], "doc_id long, text string, n_lines int, source string, version string").repartition(4)
    out = drop_repeated_lines(frame, 2, 16)
    assert out.columns == ["doc_id", "text", "source", "version", "n_lines", "n_exact", "n_near"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_exact, r.n_near) for r in out.collect()), key=repr)
    assert got == brute(rows, 2, 16)
    assert drop_repeated_lines(frame.where("false"), 2, 16).count() == 0


def test_plan_is_native(spark, monkeypatch):
    saved = []
    real = common.save
    for module in (common, line_dedup):
        monkeypatch.setattr(module, "save", lambda df, *rest: (saved.append(df._jdf.queryExecution().toString()), real(df, *rest))[1])
    monkeypatch.setattr(common, "SMALL_BLOCK", 1)
    docs = spark.createDataFrame([(k, f"one line that is long enough to count {k}\n" * 3) for k in (1234, 5678, 9012)], "doc_id long, text string")
    plans = [*saved, drop_repeated_lines(docs)._jdf.queryExecution().toString(), *saved]
    assert len(plans) > 10 and any("ref_line" in p for p in plans)
    for plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_copies_of_short_lines(spark):
    long = "one line that is long enough to count, number "
    rows = [(1, f"Menu\n\n  \n{long}1\nMenu"), (2, f"Menu\nMenU\n\n  \nx\n{long}12"), (3, f"x\nMenu \nMenu\n{long}1"), (None, "Menu"), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in drop_repeated_lines(frame, exact_chars=1).collect()}
    assert got == {1: (f"Menu\n\n  \n{long}1", 5, 1, 0), 2: ("MenU\n\n  \nx", 6, 1, 1), 3: ("Menu ", 4, 3, 0), None: ("Menu", 1, 0, 0), 4: (None, 0, 0, 0)}


def test_pipeline_drops_short_copies(spark):
    import corpus_pipeline

    frame = spark.createDataFrame([(1, "All rights reserved.\nfirst"), (2, "second\nAll rights reserved."), (3, "first")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.repeated_lines(spark, frame, "").collect()} == {(1, "All rights reserved.\nfirst"), (2, "second")}
