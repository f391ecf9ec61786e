"""Fixed rules against a plain function; mined rules against counting."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.llm import url_filters as uf


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for what, text in uf.RULES:
        own, _, prefix = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + prefix) and (best is None or len(text) > len(best[1])):
            best = (what, text)
    return host, path, best and best[1], best and best[0]


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://a.org/x", "https://Example.ORG/es/1", "http://www.example.org/en/12?q=1", "http://example.org/en/2",
    "http://notexample.org/es/", "http://xorg/", "http://x.com/fr/", "http://x.com/de/?a=/fr/", "http://x.com/FR/", "http://x.com?/de/", "http://x.com#/de/", "a://b://c.com/de/", "http://É.com/de/x", "http://x.org:80/", "http://x.com/de/\n/x", "http://x/" + "a/" * 5000,
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "c", 1) for i, u in enumerate(URLS + URLS[3:9])], "page_id long, url string, rule string, tokens int").repartition(3)
    labels = spark.createDataFrame([], "url string, block boolean")
    got = {r.page_id: r for r in uf.judge(pages, labels).collect()}
    assert len(got) == len(URLS) + 6
    for i, url in enumerate(URLS + URLS[3:9]):
        host, path, rule, verdict = plain(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url
    assert uf.judge(pages.where("false"), labels).count() == 0


def test_mined_rules(spark):
    rnd = random.Random(1)
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice('ab')}.{rnd.choice(['net', 'info'])}/{rnd.choice(['x', 'y', 'shop'])}/{rnd.randint(1, 9)}{rnd.choice(['', '?p=1', '#top'])}" for _ in range(400)]
    bad = lambda u: "shop" in u and "a.net" in u
    rows = [(u, bad(u)) for u in urls] + [(None, True), ("x", True), ("http://a.net/shop/1", None)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    tokens = labelled.select(uf.url_tokens(F.col("url")).alias("tokens"), "block")
    held = [(frozenset(r.tokens), r.block) for r in tokens.where("block is not null and size(tokens) > 0").collect()]
    rules = {frozenset(r.tokens): r.confidence for r in uf.mine(tokens, 0.02, 0.6).collect()}
    sure = {}
    for size in range(1, 6):
        for some in {c for s, _ in held for c in combinations(sorted(s), size)}:
            own = [b for s, b in held if s >= set(some)]
            if sum(own) >= 0.02 * len(held) and sum(own) >= 0.6 * len(own):
                sure[frozenset(some)] = sum(own) / len(own)
    want = {k: v for k, v in sure.items() if not any(o < k and sure[o] >= v for o in sure)}
    assert {k: round(v, 9) for k, v in rules.items()} == {k: round(v, 9) for k, v in want.items()} and want
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in uf.judge(pages, labelled, min_support=0.02, min_confidence=0.99).collect():
        assert r.verdict == ("block" if bad(urls[r.page_id]) else "allow") and r.mined == bad(urls[r.page_id])


def test_long_urls_are_mined_whole(spark):
    """More than 24 tokens, those that tell in the last places in order; 30 keys that
    always stand together must not be paired among each other."""
    rnd = random.Random(2)
    keys = "&".join(f"k{chr(97 + k // 26)}{chr(97 + k % 26)}=1" for k in range(30))
    urls = [f"http{rnd.choice(['', 's'])}://a.net/{rnd.choice('xy')}/{rnd.choice(['', 'end/'])}?{keys}{rnd.choice(['', '&zz=1'])}" for _ in range(120)]
    urls += [f"http://b.net/{rnd.choice('xy')}" for _ in range(60)]
    bad = lambda u: u.startswith("https") and "zz" in u or "end/" in u and rnd.random() < 0.9 or rnd.random() < 0.2
    labelled = spark.createDataFrame([(u, bad(u)) for u in urls], "url string, block boolean").select(uf.url_tokens(F.col("url")).alias("tokens"), "block").cache()
    held = [(frozenset(r.tokens), r.block) for r in labelled.collect()]
    assert max(len(t) for t, _ in held) > 30
    many = {f"query:k{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30)}
    few = lambda tokens: len(many & set(tokens)) <= 1
    every, sure = sorted(set().union(*(t for t, _ in held))), {}
    one = [t for t in every if t not in many] + ["query:kaa"]
    for size in range(1, len(one) + 1):
        for some in combinations(one, size):
            own = [b for s, b in held if s >= set(some)]
            if sum(own) >= 0.05 * len(held) and sum(own) >= 0.5 * len(own):
                sure[frozenset(some)] = sum(own) / len(own)
    want = {k: round(v, 9) for k, v in sure.items() if not any(o < k and sure[o] >= v for o in sure)}
    want = {frozenset(m if t == "query:kaa" else t for t in k): v for k, v in want.items() for m in many}
    got = [(frozenset(r.tokens), round(r.confidence, 9)) for r in uf.mine(labelled, 0.05, 0.5).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want
    assert any("query:zz" in k for k in want) and all(map(few, want))


def test_least_rows_and_hot_token_sets(spark, monkeypatch):
    url = lambda k, part: f"http://h{k % 3}.net/{part}/{k}"
    labelled = spark.createDataFrame([(url(k, "bad"), True) for k in range(25)] + [(url(k, "rare"), True) for k in range(5)] + [(url(k, "good"), False) for k in range(60)], "url string, block boolean")
    pages = spark.createDataFrame([(k, url(0, "bad")) for k in range(40)] + [(100 + k, url(k, p)) for k in range(6) for p in ("bad", "rare", "good")] + [(200, None), (201, None), (None, url(1, "bad"))], "page_id long, url string")

    def verdicts(share, rows):
        monkeypatch.setattr(uf, "HOT_SHARE", share)
        return sorted(((r.page_id, r.path, r.verdict) for r in uf.judge(pages, labelled, min_support=0.01, min_confidence=0.9, min_rows=rows).collect()), key=repr)

    few, hot, strict = verdicts(1, 1), verdicts(1000, 1), verdicts(3, 20)
    assert few == hot and len(few) == pages.count()
    blocked = lambda found: {p.split("/")[1] for _, p, v in found if v == "block"}
    assert blocked(few) == {"bad", "rare"} and blocked(strict) == {"bad"}


def enumerated(held, least, margin=uf.MARGIN):
    """(tokens, verdict) -> confidence of the rules for both verdicts, by counting; rules
    that a part of theirs is as sure as are left out before the margin is asked for."""
    out = {}
    for verdict in ("block", "allow"):
        rows = [(t, b == (verdict == "block")) for t, b in held]
        base, sure = sum(b for _, b in rows) / len(rows), {}
        level = [frozenset()]
        while level:
            wider = set()
            for part in level:
                for t in {t for s, b in rows if b and s >= part for t in s - part}:
                    own = [b for s, b in rows if s >= part | {t}]
                    if sum(own) >= least:
                        wider.add(part | {t})
                        if sum(own) >= 0.5 * len(own):
                            sure[part | {t}] = (sum(own) / len(own), len(own))
            level = wider
        for k, (c, n) in sure.items():
            if not any(o < k and sure[o][0] >= c for o in sure) and c - margin * (c * (1 - c) / n) ** 0.5 > base:
                out[k, verdict] = (round(c, 9), round(c / base, 9))
    return out


def test_query_mines_rules_of_both_verdicts(spark):
    """The registered query on the given tables: its rules by enumeration, its rows by a
    plain version with those rules."""
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    quality = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect():
        quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    tokens = {r.page_id: frozenset(r.tokens) for r in frame.select("page_id", uf.url_tokens(F.col("url")).alias("tokens")).collect()}
    held = [(tokens[p], quality[p] == 0) for p, _ in pages if p in quality and tokens[p]]
    rules = enumerated(held, max(uf.MIN_ROWS, uf.MIN_SUPPORT * len(held)))
    assert rules
    labelled = spark.createDataFrame([(sorted(t), b) for t, b in held], "tokens array<string>, block boolean")
    mined = {(frozenset(r.tokens), r.verdict): (round(r.confidence, 9), round(r.lift, 9)) for r in uf.mine_both(labelled, min_rows=uf.MIN_ROWS).collect()}
    assert mined == rules
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.mined) for r in uf.op10_association_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    for page, url in pages:
        host, path, rule, verdict = plain(url)
        best = max(((lift, c, sorted(k), v) for (k, v), (c, lift) in rules.items() if k <= tokens[page]), default=None)
        assert got[page] == (host, path, rule, verdict or (best[3] if best else "allow"), verdict is None and best is not None)
    assert any(r[4] for r in got.values())


def test_surest_rules_equal_every_pair_of_rules(spark):
    rnd = random.Random(8)
    rows = [({t for t in range(7) if rnd.random() < 0.6}, rnd.random() < 0.5) for _ in range(120)]
    sets = [frozenset(c) for k in range(1, 8) for c in combinations(range(7), k)]
    n = {s: sum(s <= r for r, _ in rows) for s in sets}
    both = {s: sum(s <= r and b for r, b in rows) for s in sets}
    found = [(sorted(s), n[s]) for s in sets if n[s] >= 5] + [([uf.BLOCK, *sorted(s)], both[s]) for s in sets if both[s] >= 5]
    found.append(([uf.BLOCK], sum(b for _, b in rows)))
    sure = {s: both[s] / n[s] for s in sets if both[s] >= 5 and both[s] / n[s] >= 0.5}
    want = {tuple(sorted(s)): c for s, c in sure.items() if not any(p < s and q >= c for p, q in sure.items())}
    got = uf.surest(spark.createDataFrame(found, "items array<long>, freq long"), len(rows), 0.5).collect()
    assert len(got) == len(want) > 5 and {tuple(r["items"]): r.confidence for r in got} == want
    none = spark.createDataFrame([], "items array<long>, freq long")
    assert uf.surest(none, 1, 0.5).collect() == []
