"""Collocations against a plain version of the contract."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_words=3, support=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in found.items():
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items() if p[0] in q):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=400):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "É", "\xa0x", "it's", "the", "the", "of"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", ";", "\x1c "]
    rows = [("".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "fr", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", "fr"), ("a a a a a a a a a a a a a a", "rep"), ("New York " * 30_000, "long"), ("x y", None)] + [("same line of text here", "dup")] * 30


@pytest.mark.parametrize(("max_words", "support", "share", "top", "block"), [(3, 10, 50, 2000, 1 << 23), (3, 3, 80, 5, 500), (4, 5, 30, 50, 3000), (2, 10, 50, 7, 500)])
def test_equals_plain(spark, monkeypatch, max_words, support, share, top, block):
    monkeypatch.setattr(co, "BLOCK_BYTES", block)
    rows = texts(max_words + top)
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "text string, lang string, f int, word string").repartition(5)
    assert rows_of(co.collocations(docs, max_words, support, share, top)) == plain(rows, max_words, support, share, top)


def test_products_beyond_64_bits(spark):
    # The score's SQL on counts whose products need up to 37 digits.
    a, left, right = 3 * 10**14 + 7, 9 * 10**14 + 1, 4 * 10**14 + 3
    df = spark.createDataFrame([(a, [left, 0], [right, 0])], "a long, pre array<long>, suf array<long>")
    row = df.selectExpr(f"{co.best_cut(2)} as cut").first().cut
    assert row.score == 1000000 * a * a // (left * right) and (row.k, row.l, row.r) == (1, left, right)


def test_no_rows_and_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(empty).collect() == []
    assert co.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).collect() == []


def test_packed_groups_equal_counts(spark):
    rnd = random.Random(4)
    blocks = [(b, sorted({(rnd.choice([3, 2**34, 2**40 + 1]), rnd.randint(0, 30)) for _ in range(40)})) for b in (0, 1, 2**32)]
    rows = [(b, [p[0] for p in pairs], [p[1] for p in pairs], [rnd.randint(1, 300) for _ in pairs]) for b, pairs in blocks]
    total, where = Counter(), Counter()
    for b, left, right, f in rows:
        for code, (x, y, n) in enumerate(zip(left, right, f, strict=True)):
            total[x, y] += n
            where[x, y, b, code] += 1
    heads, places = co.frequent_extended(spark.createDataFrame([*rows, (7, [], [], [])], "block long, left array<long>, right array<long>, f array<long>"), 250)
    found = {r.id: (r.left, r.right, r.a) for r in heads.collect()}
    assert sorted(found.values()) == sorted((*p, a) for p, a in total.items() if a >= 250)
    got = Counter()
    for r in places.collect():
        code = np.cumsum(co.unpacked(r.codes, r.n))
        for c, i in zip(code.tolist(), co.planes_read(r.ids, r.n).tolist(), strict=True):
            got[(*found[i][:2], r.block, c)] += 1
    assert got == Counter({k: 1 for k in where if total[k[:2]] >= 250})
