"""Personal data: fixed patterns, and a semi-Markov CRF over what they leave."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table

KINDS = ("email", "ip", "card", "phone")
#: The CRF is fitted on regions of at most so many documents (those of the smallest
#: hash of their id), of each its first few of at most so many characters: in all so
#: many with spans, and as many without. A segment has at most so many tokens.
FIT_DOCS, FIT_REGIONS_EACH, FIT_CHARS, FIT_REGIONS, EPOCHS, MAX_SEGMENT = 4096, 4, 80, 400, 6, 24

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every ip, card and phone lies in such a run.
RUN = re.compile(r"[0-9+][\x20().+0-9-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REGION = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().+-]{0,3}[0-9]){6,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def emails(text: str):
    """Leftmost non-overlapping matches of the email pattern in linear time: the
    local part of a match is all that may be one before its @."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, ordered."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for run in RUN.finditer(text):
        s, e = run.span()
        out += [(1, m.start(), m.end()) for m in IP.finditer(text, s, e) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text, s, e):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text, s, e) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def span_features(text: str, s: int, e: int) -> list[int]:
    """Numbers of the whole-span features that hold of text[s:e]."""
    span = text[s:e]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall("[0-9]+", span)
    n, tail = len(digits), [len(g) for g in groups[-3:]]
    left, right = text[s - 1 : s], text[e : e + 1]
    name, _, host = span.partition("@")
    letters = any(c.isalpha() for c in span)
    tests = (
        True,
        n < 7, 7 <= n <= 15, 16 <= n <= 19, n > 19, n == 10 or n == 11,
        13 <= n <= 19 and luhn(digits),
        span[0] == "+", span[0] == "(", span[0] not in "+(" and not span[0].isalnum(), not span[-1].isalnum(),
        not letters and len(groups) == 4 and span.replace(".", "") == digits and all(map(_small, groups)) and ".." not in span,
        span.count("@") == 1 and bool(name) and bool(host), bool(DOMAIN.fullmatch(host)), letters,
        len(groups) == 1, tail == [3, 3, 4], bool(groups) and all(len(g) == 4 for g in groups), span.count("(") == span.count(")"), "(" in span,
        bool(re.search(r"[\x20().+-]{3}", span)), left.isalnum(), right.isalnum(), left == "." or right == ".",
    )
    return [k for k, held in enumerate(tests) if held]


N_FEATURES = 24


class SemiCRF:
    """Segments of tokens are entities of a kind, at most ``max_segment`` tokens
    long, or single tokens outside. An entity's score is the sum of its kind's
    weights for its whole-span features, plus one weight if it follows an entity."""

    def __init__(self, weights=None, max_segment: int = MAX_SEGMENT):
        self.w = list(weights) if weights is not None else [0.0] * (N_FEATURES * len(KINDS) + 1)
        self.max_segment = max_segment

    def lattice(self, text: str, tokens: list[tuple[int, int]], barred=frozenset()):
        """features[i][j - i - 1] of the segment of tokens i..j-1; None where barred."""
        n = len(tokens)
        return [[None if any(k in barred for k in range(i, j)) else span_features(text, tokens[i][0], tokens[j - 1][1]) for j in range(i + 1, min(n, i + self.max_segment) + 1)] for i in range(n)]

    def scores(self, lattice):
        w, size = self.w, N_FEATURES
        return [[None if f is None else [sum(w[k * size + x] for x in f) for k in range(len(KINDS))] for f in row] for row in lattice]

    def rows(self, text: str, tokens: list[tuple[int, int]], barred=frozenset()):
        """The rows of ``scores`` one by one: what is held is a row, not the lattice."""
        w, size, n = self.w, N_FEATURES, len(tokens)
        for i in range(n):
            row = []
            for j in range(i + 1, min(n, i + self.max_segment) + 1):
                if j - 1 in barred:  # and so any longer segment
                    break
                f = span_features(text, tokens[i][0], tokens[j - 1][1])
                row.append([sum(w[k * size + x] for x in f) for k in range(len(KINDS))])
            yield row

    def decode(self, scores) -> list[tuple[int, int, int]]:
        """The best segmentation's entities, as (kind, first token, end token)."""
        return [found[:3] for found in self.decode_scored(scores)]

    def decode_scored(self, scores) -> list[tuple[int, int, int, float]]:
        """``decode`` with each entity's score, from an iterable of rows. A step needs the
        row of one token and the best scores up to ``max_segment`` tokens ahead."""
        glue, ahead = self.w[-1], [[0.0, -math.inf]]
        back: list[list] = [[None, None]]
        n = 0
        for i, row in enumerate(scores):
            n = i + 1
            while len(ahead) < len(row) + 2:
                ahead.append([-math.inf, -math.inf])
                back.append([None, None])
            here = ahead.pop(0)
            state = int(here[1] > here[0])
            if here[state] > ahead[0][0]:
                ahead[0][0], back[i + 1][0] = here[state], (i, state, None, 0.0)
            before, state = max(here[0], here[1] + glue), int(here[1] + glue > here[0])
            for d, kinds in enumerate(row):
                if kinds is not None:
                    k = max(range(len(KINDS)), key=kinds.__getitem__)
                    if before + kinds[k] > ahead[d][1]:
                        ahead[d][1], back[i + d + 1][1] = before + kinds[k], (i, state, k, kinds[k])
        at, state, out = n, int(ahead[0][1] > ahead[0][0]), []
        while at:
            prev, before, kind, value = back[at][state]
            if kind is not None:
                out.append((kind, prev, at, value))
            at, state = prev, before
        return out[::-1]

    def expectations(self, scores, lattice):
        """(log partition function, expected feature counts)."""
        n, glue = len(scores), self.w[-1]
        add = lambda *x: (m := max(x)) + math.log(sum(math.exp(v - m) for v in x)) if max(x) > -math.inf else -math.inf
        fore = [[0.0, -math.inf]] + [[-math.inf, -math.inf] for _ in range(n)]
        for i in range(n):
            fore[i + 1][0] = add(fore[i + 1][0], fore[i][0], fore[i][1])
            before = add(fore[i][0], fore[i][1] + glue)
            for d, kinds in enumerate(scores[i]):
                if kinds is not None:
                    fore[i + d + 1][1] = add(fore[i + d + 1][1], *(before + s for s in kinds))
        rear = [[-math.inf, -math.inf] for _ in range(n)] + [[0.0, 0.0]]
        for i in range(n - 1, -1, -1):
            begun = add(-math.inf, *(add(*kinds) + rear[i + d + 1][1] for d, kinds in enumerate(scores[i]) if kinds is not None))
            rear[i] = [add(rear[i + 1][0], begun), add(rear[i + 1][0], begun + glue)]
        total = add(*fore[n])
        out = [0.0] * len(self.w)
        for i in range(n):
            for d, kinds in enumerate(scores[i]):
                if kinds is not None:
                    for k, s in enumerate(kinds):
                        after = s + rear[i + d + 1][1] - total
                        glued = math.exp(fore[i][1] + glue + after)
                        p = math.exp(fore[i][0] + after) + glued
                        out[-1] += glued
                        for x in lattice[i][d]:
                            out[k * N_FEATURES + x] += p
        return total, out

    def learn(self, regions, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-3):
        """Stochastic gradient ascent on the likelihood of ``regions``: (text, entities as (kind, start, end))."""
        ready = []
        for text, gold in regions:
            tokens = [m.span() for m in TOKEN.finditer(text)]
            starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            spans = sorted((starts[s], ends[e], k) for k, s, e in gold if s in starts and e in ends)
            if all(b - a <= self.max_segment for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False)):
                ready.append((self.lattice(text, tokens), spans))
        for _ in range(epochs):
            for lattice, spans in ready:
                _, expected = self.expectations(self.scores(lattice), lattice)
                step = [-x for x in expected]
                for a, b, k in spans:
                    for x in lattice[a][b - a - 1]:
                        step[k * N_FEATURES + x] += 1
                step[-1] += sum(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
                self.w = [w * (1 - rate * decay) + rate * g for w, g in zip(self.w, step, strict=True)]
        return self


def regions_of(text: str):
    """(start, end) of the parts of a text in which the CRF looks for entities."""
    return [m.span() for m in REGION.finditer(text)]


#: Other ways to write a phone or card: what a base span's separators become.
SPELLINGS = {3: (("-", "-"), (".", "."), (" ", " ")), 2: ((".", "."), ("-", " "))}


def training_regions(text: str, most: int = FIT_REGIONS_EACH):
    """Regions with a little of their surroundings and the base spans in them. A span
    that stands alone is given again as people also write it: a phone without its
    prefix, and with one sign between its groups of digits; a card with dots, or with
    signs of two kinds. So other features than the base patterns' count as well."""
    base, out = base_spans(text), []
    for s, e in regions_of(text)[:most]:
        if e - s > FIT_CHARS:
            continue
        a, b = max(0, s - 6), min(len(text), e + 6)
        gold = [(k, x - a, y - a) for k, x, y in base if x >= a and y <= b]
        part = text[a:b]
        out.append((part, gold))
        if len(gold) != 1:
            continue
        ((k, x, y),) = gold
        span = part[x:y]
        cut = re.match(r"\+[0-9]{1,3}\x20", span)
        short = span[cut.end() :] if k == 3 and cut else span
        spelled = [short] if short != span else []
        groups = re.findall("[0-9]+", short)
        if k == 2 and len(groups) == 1:
            groups = [span[i : i + 4] for i in range(0, len(span), 4)]
        if k in SPELLINGS and len(groups) > 1:
            spelled += [groups[0] + "".join((one if i % 2 else other) + g for i, g in enumerate(groups[1:])) for one, other in SPELLINGS[k]]
        out += [(part[:x] + w + part[y:], [(k, x, x + len(w))]) for w in spelled if w != span]
    return out


def fit(docs: DataFrame, sample_docs: int = FIT_DOCS) -> list[float]:
    """Weights learned from the base spans of a bounded sample of documents; all 0
    (no spans are added) if the sample has none."""
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")

    def cut(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            rows = [(i, json.dumps(r), bool(r[1])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for r in training_regions(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["doc_id", "region", "held"])

    def learn(group):
        import json

        import pyarrow as pa

        regions = sorted(map(json.loads, group.column("region").to_pylist()))
        crf = SemiCRF().learn(regions) if regions else SemiCRF()
        return pa.table({"at": pa.array(range(len(crf.w)), pa.int64()), "w": pa.array(crf.w, pa.float64())})

    found = save(sample.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, region string, held boolean"), "regions")
    some = lambda held: found.where(F.col("held") == held).orderBy(F.xxhash64("doc_id", "region"), "doc_id", "region").limit(FIT_REGIONS)
    chosen = some(True).unionAll(some(False)) if not found.where("held").isEmpty() else found.where("false")
    rows = chosen.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "at long, w double").collect()
    return [r.w for r in sorted(rows)] or list(SemiCRF().w)


def find_spans(docs: DataFrame, weights: list[float], min_score: float = 1.0) -> DataFrame:
    """Rows (doc_id, spans array<struct<kind, start, end, base>>), one per row of
    ``docs(doc_id, text)``; offsets count code points, ends are exclusive; ordered
    by kind as in ``KINDS``, then start.

    Base spans are the fixed patterns' and always stay. Elsewhere in the text the
    CRF decodes regions that hold an @ or 7 digits; an entity is added if it
    touches no base span and scores ``min_score`` at least. A null text is empty; a
    null doc_id stays null; repeated rows give a row each; no rows give none.
    """

    def find(batches):
        import pyarrow as pa

        crf = SemiCRF(weights)
        learned = any(weights)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                spans = [(k, s, e, True) for k, s, e in base]
                for a, b in regions_of(text) if learned else ():
                    near = [(s, e) for _, s, e in base if s < b and e > a]
                    if any(s <= a and e >= b for s, e in near):
                        continue
                    tokens = [(a + m.start(), a + m.end()) for m in TOKEN.finditer(text[a:b])]
                    barred = {i for i, (s, e) in enumerate(tokens) if any(s < y and e > x for x, y in near)}
                    if len(tokens) - len(barred) < 2:
                        continue
                    found = crf.decode_scored(crf.rows(text, tokens, barred))
                    spans += [(k, tokens[i][0], tokens[j - 1][1], False) for k, i, j, value in found if value >= min_score]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
