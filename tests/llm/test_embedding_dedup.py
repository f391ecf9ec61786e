"""Recall and exactness of near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from tidemark.llm import embedding_dedup
from tidemark.llm.embedding_dedup import code_size, near_duplicates


def brute(rows, threshold=0.98):
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float64(rows[a][1]), np.float64(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
    comp = list(range(len(rows)))
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        ids = [rows[s][0] for s in seen]
        comp[k] = None if ids == [None] else min(ids)
    return sorted(((r[0], len(links[k]), comp[k], r[0] is not None and r[0] == comp[k]) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("tile", [512, 5])
def test_against_all_pairs(spark, tile):
    rnd = np.random.RandomState(0)
    rows, at = [], 0
    for c in range(12):
        base = rnd.standard_normal(32)
        for _ in range(rnd.randint(1, 12)):
            v = base + rnd.standard_normal(32) * rnd.choice([0, 0.02, 0.05])
            rows.append((int(at), [float(np.float32(x)) for x in v], int(c % 3)))
            at += 1
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [1.0, None], 1), (903, [float("nan")] * 32, 1), (904, [float("inf")] + [1.0] * 31, 1), (905, rows[0][1], None), (None, rows[0][1], rows[0][2]), (906, [], 1), (907, [1e30, 1e30], 1), (908, [2e30, 2e30], 1), rows[3], rows[3], (909, [-x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, cid int").repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(frame, tile=tile).collect()), key=repr)
    want = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert len(got) == len(want)
    found, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found >= 0.97 * all_links and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    if found == all_links:
        assert got == want
    assert near_duplicates(frame.where("false")).count() == 0


def test_recall_on_given_vectors(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    frame = spark.read.parquet(path)
    want = {w[0]: w for w in brute([tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()])}
    got = {r.vec_id: r for r in near_duplicates(frame).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(w[1] for w in want.values())
    assert all(got[k].n_links <= want[k][1] for k in want)


def test_code_size_keeps_recall():
    assert code_size(5000) == (16, 14) and code_size(0) == (16, 14)
    for n in (10**5, 10**7, 10**9):
        bits, tables = code_size(n)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert 2**bits >= 4 * n and (1 - agree) ** tables <= 0.003 < (1 - agree) ** (tables - 1)


def test_more_bits_find_the_same_links(spark, monkeypatch):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    few = sum(r.n_links for r in near_duplicates(frame).collect())
    monkeypatch.setattr(embedding_dedup, "LEAST_BITS", 22)
    assert sum(r.n_links for r in near_duplicates(frame).collect()) >= 0.97 * few
