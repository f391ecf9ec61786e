"""Recursions against enumeration of all paths, and the query's columns against plain counts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import hidden_markov as hm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(rnd, states=3, words=5):
    return rnd.dirichlet(np.ones(words + 1), states).T[:words].copy(), rnd.dirichlet(np.ones(states), states), rnd.dirichlet(np.ones(states)), rnd.dirichlet(np.ones(states))


def paths(codes, emit, moves, first):
    """Probability of every path of states."""
    out = {}
    for path in itertools.product(range(len(moves)), repeat=len(codes)):
        p = first[path[0]] * emit[codes[0], path[0]]
        for i in range(1, len(codes)):
            p *= moves[path[i - 1], path[i]] * emit[codes[i], path[i]]
        out[path] = p
    return out


def test_recursions_equal_all_paths(monkeypatch):
    monkeypatch.setattr(hm, "BATCH_TOKENS", 7)
    rnd = np.random.RandomState(1)
    emit, moves, first, within = parts(rnd)
    length = np.array([3, 1, 5, 2, 4, 1])
    codes, start, opens = rnd.randint(0, 5, length.sum()), np.cumsum(length) - length, np.array([1, 1, 0, 1, 0, 1], bool)
    counts, moved, begun = np.zeros_like(emit), np.zeros_like(moves), np.zeros(3)
    likely = []
    for s, n, o in zip(start, length, opens, strict=True):
        found = paths(codes[s : s + n], emit, moves, first if o else within)
        total = sum(found.values())
        likely.append(math.log10(sum(paths(codes[s : s + n], emit, moves, first).values())))
        for path, p in found.items():
            begun[path[0]] += o * p / total
            for i in range(n):
                counts[codes[s + i], path[i]] += p / total
                if i:
                    moved[path[i - 1], path[i]] += p / total
    got = hm.expected(codes, start, length, opens, emit, moves, first, within)
    for a, b in zip(got, (counts, moved, begun), strict=True):
        assert np.allclose(a, b, rtol=1e-10)
    assert np.allclose(hm.log_likelihoods(codes, start, length, emit, moves, first), likely, rtol=1e-12)


def test_cut_keeps_every_token():
    length = np.array([1, 512, 513, 1025, 7])
    start, size, opens = hm.cut(length)
    assert sorted(t for s, n in zip(start, size, strict=True) for t in range(s, s + n)) == list(range(length.sum()))
    assert opens.sum() == len(length) and size.max() <= hm.CUT_TOKENS


def test_long_sequence_does_not_underflow():
    emit, moves, first, _ = parts(np.random.RandomState(2))
    codes = np.random.RandomState(3).randint(0, 5, 300_000)
    got = hm.log_likelihoods(codes, np.array([0]), np.array([len(codes)]), emit * 1e-9, moves, first)
    assert np.isfinite(got).all() and got[0] < -9 * len(codes)


def test_emissions_are_distributions():
    own = np.array([[7.0, 1.0], [1.0, 1.0], [0.0, 3.0], [1.0, 0.0], [0.5, 0.5]])
    c = np.array([8, 2, 3, 1, 1])
    model = hm.Model(own[:1].sum(0), hm.by_count(own, c), [2, 1, 1, 0, 0], np.ones((2, 2)), np.ones(2), int(c.sum()))
    emit = model.emissions(np.append(c, 0), np.array([0]), own[:1])
    assert np.allclose(emit.sum(0), 1)  # the last row is all that is not known
    assert np.allclose(model.moves.sum(1), 1) and math.isclose(model.first.sum(), 1)
    assert np.array_equal(emit[3], emit[4])  # words that occur once are alike


def plain(rows):
    train, out = Counter(), {}
    tokens = {i: [*WORDS.findall((t or "").translate(LOWER)), None] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    for i, found in tokens.items():
        if not held[i]:
            train.update(found)
    n, v = sum(train.values()), len(train)
    for i, found in tokens.items():
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in found)
        out[i] = (held[i], len(found), sum(train[w] > 0 for w in found), n, base)
    return out


def equal(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4] and math.isclose(g.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9)


def test_query_on_small_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hm, "BLOCK_BYTES", 2000)
    rnd = random.Random(5)
    lists = ["red green blue teal".split(), "UN DEUX TROIS é \xa0".split(" "), "1 2 3 4 5".split()]
    rows = [(i, " ".join(rnd.choice(lists[i % 3]) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rows += [(None, "no id here"), (400, None), (401, ""), (402, "long " * 50_000 + "END"), (403, "a\x1cb\x0bc\x85d"), (404, "unheard-of words")]
    spark.createDataFrame([(*r, 1.0, "w") for r in rows], "doc_id long, text string, score double, word string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = hm.op11_hidden_markov_scores(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    equal(got, plain(rows))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    # The states find the three languages.
    short = [r for r in found if r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in short) > 0.75 * sum(r.base_score for r in short)


def test_passes_raise_the_likelihood(spark):
    # More rounds at the start leave little to do on so few documents.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    total = [docs_score(hm.score_texts(docs, passes=k, start_rounds=2)) for k in (0, 1, 3)]
    assert total[0] < total[1] < total[2]


def docs_score(scored):
    return sum(r.score for r in scored.where("not held_out").collect())


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = hm.op11_hidden_markov_scores(spark, sf).collect()
    equal({r.doc_id: r for r in found}, plain(rows))
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hm.score_texts(empty).collect() == []
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = hm.score_texts(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, round(row.score, 9)) == (3, 0, 0, 0.0, 0.0)


def test_start_counts_all_training_documents(spark, monkeypatch):
    # A start from a part of the documents would give words it lacks no shares of the states.
    assert not hasattr(hm, "START_DOCS")
    seeds = np.array([1, 2, -(2**63), 2**63 - 1])
    shares = hm.start_weights(seeds, 6)
    assert np.allclose(shares.sum(1), 1) and (shares > 0).all() and len({tuple(r) for r in shares.round(9)}) == 4
    assert np.array_equal(shares[[2]], hm.start_weights(seeds[[2]], 6))
    # However the documents are dealt, counts of all of them make the same model.
    monkeypatch.setattr(hm, "BLOCK_BYTES", 1 << 40)
    rows = [(i, f"w{i % 7} v{i % 5} " * (1 + i % 4)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, many = ({r.doc_id: r.score for r in hm.score_texts(d, start_rounds=1).collect()} for d in (docs.coalesce(1), docs))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-4) for i in one)


def test_words_travel_in_packed_rows(spark, monkeypatch):
    # A row for each word of each block, as it was before, is what most of the time went to.
    stored, saved = [], hm.save
    monkeypatch.setattr(hm, "save", lambda df, name: stored.append((out := saved(df, name)).count()) or out)
    rnd = random.Random(7)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.5)) % 5000}" for _ in range(30))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    equal({r.doc_id: r for r in hm.score_texts(docs).collect()}, plain(rows))
    assert max(stored) < len({w for _, text in rows for w in text.split()}) / 2


def test_shares_make_no_difference(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randint(0, 99) * rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 30)))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(hm, "BLOCK_BYTES", 20_000)
    scores = []
    for words, least in ((1 << 40, 1), (10, 1), (400_000, 64)):
        monkeypatch.setattr(hm, "SHARE_WORDS", words)
        monkeypatch.setattr(hm, "LEAST_SHARES", least)
        found = hm.score_texts(docs).collect()
        equal({r.doc_id: r for r in found}, plain(rows))
        scores.append({r.doc_id: r.score for r in found})
    assert all(s.keys() == scores[0].keys() and all(math.isclose(s[i], scores[0][i], rel_tol=1e-6) for i in s) for s in scores)


def test_shuffled_files_go_with_their_table(spark, monkeypatch):
    key, seen, saved = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], hm.save
    monkeypatch.setattr(hm, "save", lambda df, name: seen.append(spark.conf.get(key)) or saved(df, name))
    before = spark.conf.get(key)
    hm.score_texts(spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string"))
    assert seen and set(seen) == {"true"} and spark.conf.get(key) == before
    for kind in (np.int32, np.int64, np.uint32, np.float32):
        for n in (0, 1, 1000):
            x = (np.random.RandomState(n).random_sample(n) * 1e6).astype(kind)
            assert np.array_equal(hm.unpressed(hm.pressed(x, kind), n, kind), x)
