"""Positional index against brute force on small tables."""

import random
import re

import pytest

from tidemark.llm import decontamination
from tidemark.llm.decontamination import find_items

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            b = words(body)
            for at in range(max(1, len(b) - window + 1)) if b else ():
                run = b[at : at + window]
                for i in range(len(w) - len(run) + 1):
                    if w[i : i + len(run)] == run:
                        hit |= set(range(i, i + len(run)))
                        if item is not None:
                            ids.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(3)
    vocabulary = ["a", "B", "ça", "é1", "dd", "the", "THE", "x"]
    text = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ".", "\n", "-"]) for _ in range(n))
    items = [(i, text(rnd.randint(1, 12))) for i in range(20)] + [(3, "a b"), (40, None), (41, ""), (42, " .. "), (None, "x x dd"), (2, "one never seen word")]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(7, "the"), (7, "the"), (None, "a b c"), (99, None), (98, ""), (97, "a " * 30_000)]
    return docs, items


@pytest.mark.parametrize("shard", [8192, 5])
def test_exact_matches(spark, tables, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_DOCS", shard)
    docs, items = tables
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, term string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for window in (4, 10):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in find_items(d, b, window).collect()), key=repr)
        assert got == brute(docs, items, window)
    assert find_items(d.where("false"), b).count() == 0
    none = find_items(d, b.where("false")).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and r.item_ids == [] for r in none)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "p q z r s"), (2, "p q z z z z z r s"), (3, "p q r s"), (4, "q r s")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "p q r s")], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.near_item_ids) for r in find_items(d, b, slop=2).collect()}
    assert got == {1: ([], ["5"]), 2: ([], []), 3: (["5"], ["5"]), 4: ([], [])}


def test_index_holds_every_posting(spark, tables):
    docs, _ = tables
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 3).collect()
    import numpy as np

    (head,) = [r for r in index if r.term is None]
    assert head.n_words == [len(words(t)) for _, t in docs] and head.doc_ids == [d for d, _ in docs]
    want, base = {}, 0
    for _, text in docs:
        for k, w in enumerate(words(text)):
            want.setdefault(w, []).append(base + k)
        base += len(words(text)) + 3
    got = {r.term: np.cumsum(np.frombuffer(r.positions, np.int32)).tolist() for r in index if r.term is not None}
    assert got == want and all(r.n == len(want[r.term]) for r in index if r.term is not None)


def brute_near(docs, items, window, slop):
    """Near items by place: around each place of a window's rarest word all its words."""
    from collections import Counter

    bodies = [(d, words(t)) for d, t in docs]
    freq = Counter(w for _, b in bodies for w in b)
    out = []
    for doc_id, body in bodies:
        ids = set()
        for item, text in items:
            b = words(text)
            for at in range(max(1, len(b) - window + 1)) if b and item is not None else ():
                run = b[at : at + window]
                if not all(freq[t] for t in run):
                    continue
                k = min(range(len(run)), key=lambda i: (freq[run[i]], i))  # noqa: B023
                for p in (p for p, w in enumerate(body) if w == run[k]):
                    base = p - k
                    if all(any(0 <= q < len(body) and body[q] == t for q in range(base + i - slop, base + i + slop + 1)) for i, t in enumerate(run)):
                        ids.add(str(item))
        out.append((doc_id, sorted(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "slop"), [(8192, 2), (5, 1)])
def test_near_matches(spark, tables, monkeypatch, shard, slop):
    monkeypatch.setattr(decontamination, "SHARD_DOCS", shard)
    docs, items = tables
    docs = [r for r in docs if r[0] != 97]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = find_items(d, b, 5, slop).collect()
    assert sorted(((r.doc_id, r.near_item_ids) for r in rows), key=repr) == brute_near(docs, items, 5, slop)
    assert sum(len(r.near_item_ids) for r in rows) > sum(len(r.item_ids) for r in rows)


def test_query_returns_near_items(spark, tmp_path):
    passage = [f"w{k}" for k in range(14)]
    changed = " ".join([*passage[:3], "new", *passage[3:]])
    spark.createDataFrame([(1, " ".join(passage)), (2, changed), (3, "other words"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(8, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_items, r.n_near_items, r.contaminated) for r in decontamination.op1_positional_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, True), 3: (0, 0, False), None: (0, 0, False)}
