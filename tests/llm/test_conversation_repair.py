"""Searches against enumeration, and the query against a plain version of its contract."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import conversation_repair as cr

FOLLOW = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search over whole prefixes; rows are
    (role, text, fault)."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, said = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, list(said)
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in FOLLOW:
                heapq.heappush(queue, (cost + 2, audit + "I", at, role[0], (*said, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, said))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in FOLLOW:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, FOLLOW[state, role[:1]], (*said, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in FOLLOW:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, new[0], (*said, (new, text))))


def plain(rows):
    """The query's rows from (conv_id, turn, role, text) tuples."""
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in found.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults, judged = set(), [], []
        for _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            judged.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, said = cheapest(judged)
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_search_finds_the_cheapest_and_least_audit():
    rnd = random.Random(3)
    letter, faults = {0: "system", 1: "user", 2: "assistant", 3: "tool"}, {0: None, 4: "blank", 8: "truncated"}
    for _ in range(3000):
        turns = bytes(rnd.choice(range(4)) | rnd.choice([0, 0, 0, 4, 8]) for _ in range(rnd.randint(0, 9)))
        assert cr.search(turns) == cheapest([(letter[t & 3], "", faults[t & 12]) for t in turns])[:2]


def test_bounds_are_at_most_four_too_low():
    rnd = random.Random(4)
    letter, faults = {0: "system", 1: "user", 2: "assistant", 3: "tool"}, {0: None, 4: "blank", 8: "truncated"}
    for _ in range(500):
        turns = bytes(rnd.choice(range(4)) | rnd.choice([0, 0, 4, 8]) for _ in range(rnd.randint(0, 12)))
        want = cheapest([(letter[t & 3], "", faults[t & 12]) for t in turns])[0]
        assert want - 4 <= cr.suffix_bounds(turns)[0][cr.NOTHING] <= want


def test_long_conversation_is_linear():
    rnd = random.Random(5)
    turns = bytes(rnd.choice(range(4)) | rnd.choice([0, 0, 0, 4, 8]) for _ in range(200_000))
    cost, audit = cr.search(turns)
    assert sum(audit.count(c) for c in "DKR") == len(turns) and cost > 0


def test_query_equals_plain_version(spark, tmp_path):
    rnd = random.Random(6)
    texts = ["Hi.", "What?", "no stop", "", " \n", "Yes!  ", "é.\x85", None, "word " * 60_000 + "end."]
    rows = [(c, rnd.choice([t, t, t, rnd.randint(0, 9), None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "", "Tool", None]), rnd.choice(texts)) for c in [*range(60), None] for t in range(rnd.randint(1, 12))]
    rows += [(1000, 0, "user", "Once."), (1000, 0, "user", "Once."), (1001, None, None, None)]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, row long, audit string").repartition(5).write.parquet(path)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("sf", ["0.01"])
def test_query_on_the_given_table(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = cr.op12_conversation_repair(spark, sf_dir).collect()
    assert len(found) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == plain(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op12_conversation_repair(spark, str(tmp_path)).collect() == []
