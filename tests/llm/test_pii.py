"""Base spans against the patterns as given, the CRF against enumeration."""

import itertools
import math
import random
import re

from tidemark.llm import pii

GIVEN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, pattern in GIVEN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 16 <= len(digits) <= 19 and pii.luhn(digits) or k == 3 and 8 <= len(digits) <= 15:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def test_base_spans():
    rnd = random.Random(2)
    parts = ["a", "@", ".", "b.c", "_", "é", "٣", " ", "-", "+", "(", ")", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "x@y.z", "\n", "00", "+12345678"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("1" * 100_000 + " " + "a" * 100_000 + "@" + "1." * 50_000) is not None


def test_crf_equals_enumeration():
    rnd = random.Random(4)
    crf = pii.SemiCRF([rnd.uniform(-1, 1) for _ in range(pii.N_FEATURES * 4 + 1)], max_segment=3)
    text = "+1 (2)@a"
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    lattice = crf.lattice(text, tokens, {4})
    scores, n = crf.scores(lattice), len(tokens)
    best, total = (-math.inf, None), 0.0
    for cuts in itertools.product((0, 1), repeat=n - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        segments = list(itertools.pairwise(edges))
        for kinds in itertools.product((None, 0, 1, 2, 3), repeat=len(segments)):
            value, before, fine = 0.0, False, True
            for (a, b), k in zip(segments, kinds, strict=True):
                if k is None:
                    fine &= b - a == 1
                    before = False
                elif b - a > 3 or scores[a][b - a - 1] is None:
                    fine = False
                else:
                    value += scores[a][b - a - 1][k] + (crf.w[-1] if before else 0)
                    before = True
                if not fine:
                    break
            if fine:
                total += math.exp(value)
                best = max(best, (value, [(k, a, b) for (a, b), k in zip(segments, kinds, strict=True) if k is not None]), key=lambda x: x[0])
    assert crf.decode(scores) == best[1]
    assert [row + [None] * (len(scores[i]) - len(row)) for i, row in enumerate(crf.rows(text, tokens, {4}))] == scores
    assert crf.decode(crf.rows(text, tokens, {4})) == best[1]
    log_total, expected = crf.expectations(scores, lattice)
    assert math.isclose(log_total, math.log(total), rel_tol=1e-9)
    for at in (0, 5, 30, len(crf.w) - 1):
        eps, w = 1e-5, list(crf.w)
        w[at] += eps
        moved, _ = (other := pii.SemiCRF(w, 3)).expectations(other.scores(lattice), lattice)
        assert math.isclose((moved - log_total) / eps, expected[at], abs_tol=1e-3)


def test_find_spans(spark):
    people = [f"call +1 ({200 + i}) 555-{1000 + i} or write to u{i}@mail.example.com from 10.0.{i}.7, card 4111111111111111 now" for i in range(60)]
    rows = [*enumerate(people), (100, None), (101, ""), (102, "my number is (743) 555-3824, thanks"), (103, "version 2.0.1 of 12 items, token 7c72db563d7f6e50cec00950f7ba"), (None, "a@b.c"), (100, "é a@b.c"), (100, "é a@b.c"), (104, "x " * 60_000 + "a@b.cd")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, spans string").repartition(3)
    weights = pii.fit(docs)
    got = {}
    for r in pii.find_spans(docs, weights).collect():
        got.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end, s.base) for s in r.spans])
    for i, text in enumerate(people):
        assert [(pii.KINDS.index(k), s, e) for k, s, e, b in got[i][0] if b] == plain(text)
        assert all(b for *_, b in got[i][0])
    assert sorted(got[100], key=len) == [[], [("email", 2, 7, True)], [("email", 2, 7, True)]] and got[101] == [[]] and got[103] == [[]]
    assert got[None] == [[("email", 0, 5, True)]] and got[104] == [[("email", 120_000, 120_006, True)]]
    assert [(k, b) for k, *_, b in got[102][0]] == [("phone", False)] and rows[62][1][slice(*got[102][0][0][1:3])] == "(743) 555-3824"
    assert pii.find_spans(docs.where("false"), weights).count() == 0
    assert not any(pii.fit(docs.where("false")))


def test_spellings_of_training_regions():
    made = pii.training_regions("so call +1 (743) 555-3824 or pay 4111111111111111 soon, ref 123 456 7890")
    assert [(k, t[a:b]) for t, gold in made for k, a, b in gold] == [
        (3, "+1 (743) 555-3824"), (3, "(743) 555-3824"), (3, "743-555-3824"), (3, "743.555.3824"), (3, "743 555 3824"),
        (2, "4111111111111111"), (2, "4111.1111.1111.1111"), (2, "4111 1111-1111 1111"),
    ]
    assert sum(not gold for _, gold in made) == 1


def test_long_runs_and_long_names(spark):
    name = "n" * 5000
    rows = [(1, "12 " * 4000), (2, f"to {name}@{'h' * 300}.org or @ b@ c"), (3, "+1 (743) 555-3824")] + [(10 + k, f"ring +1 ({300 + k}) 555-{2000 + k} now") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_spans(docs, pii.fit(docs)).collect()}
    assert len(got) == len(rows) and [(s.kind, s.start, s.end) for s in got[2]] == [("email", 3, 3 + 5000 + 1 + 304)]


def test_query_columns(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op7_semi_markov_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        told = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert set(told) <= set(map(":".join, spans)) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
