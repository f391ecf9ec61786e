"""Conversation structure repair by depth-first branch and bound."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save, table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: What a conversation has so far: nothing, an opening system turn, a user turn that
#: waits for its answer, an answer. It may end with nothing or an answer.
NOTHING, OPENED, ASKED, ANSWERED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: What the next turn of each role makes of it; -1: it may not follow.
AFTER = ((OPENED, ASKED, -1, -1), (-1, ASKED, -1, -1), (-1, -1, ANSWERED, -1), (-1, ASKED, -1, -1))
#: The user's or assistant's turn that may follow.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (True, False, False, True)
ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = ("system", "user", "assistant")
#: Repairs of short conversations are kept by what they look like.
MEMO_TURNS = 64

ANY = r"[^\x20\x09-\x0D]"


def suffix_bounds(turns: bytes) -> list:
    """For each place of ``turns`` (role + 4 if it must go, + 8 if cut off) and each state,
    the least cost of what is left, were a conversation free to end anywhere and to have
    no insertions at its end: never more than the true cost, and less by 4 at most."""
    after = [0, 0, 0, 0]
    bounds = [after]
    for turn in reversed(turns):
        role, gone, cut = turn & 3, turn & 4, CUT if turn & 8 else 0
        here = [DELETE + c for c in after]
        if not gone:
            for state in range(4):
                best = REROLE + cut + after[AFTER[state][NEXT[state]]]
                kept = AFTER[state][role]
                if kept >= 0:
                    best = min(best, KEEP + cut + after[kept])
                here[state] = min(here[state], best)
        # An insertion leads to another state of the same place.
        for _ in range(2):
            here = [min(c, INSERT + here[AFTER[s][NEXT[s]]]) for s, c in enumerate(here)]
        bounds.append(here)
        after = here
    bounds.reverse()
    return bounds


def search(turns: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of equal ones the ASCII-least: an initial for
    each edit in order (Delete, Insert, Keep, Rerole).

    Depth first with a stack of its own. Edits are tried in ASCII order, so prefixes come
    up in that order and a later one with the same cost at the same node (place, state)
    is dominated, as is each that costs more: the tables hold a node's least cost so far.
    A prefix is cut off too if its cost and the bound of what is left can't beat the
    incumbent. The first incumbent is the greedy repair's cost, without an audit, which
    any repair of equal cost replaces. As bounds are at most 4 too low, a node is
    expanded for at most a few different costs, and the work is linear in the turns.
    """
    n, bounds = len(turns), suffix_bounds(turns)
    limit, audit = greedy(turns, bounds) + 1, ""
    seen = [[limit] * 4 for _ in range(n + 1)]
    prefix: list[str] = []
    stack = [(0, NOTHING, 0, 0, "")]  # place, state, cost, length of the prefix, edit
    while stack:
        place, state, cost, depth, edit = stack.pop()
        if cost >= seen[place][state] or cost + bounds[place][state] >= limit:
            continue
        seen[place][state] = cost
        if edit:
            del prefix[depth - 1 :]
            prefix.append(edit)
        if place == n and ENDS[state]:
            limit, audit = cost, "".join(prefix)
            continue
        follow, deeper = AFTER[state][NEXT[state]], depth + 1
        if place < n:
            turn = turns[place]
            if not turn & 4:
                cut, kept = CUT if turn & 8 else 0, AFTER[state][turn & 3]
                stack.append((place + 1, follow, cost + REROLE + cut, deeper, "R"))
                if kept >= 0:
                    stack.append((place + 1, kept, cost + KEEP + cut, deeper, "K"))
        stack.append((place, follow, cost + INSERT, deeper, "I"))
        if place < n:
            stack.append((place + 1, state, cost + DELETE, deeper, "D"))
    return limit, audit


def greedy(turns: bytes, bounds: list) -> int:
    """Cost of the repair that always takes the edit with the least bound."""
    state, cost = NOTHING, 0
    for place, turn in enumerate(turns):
        while True:
            cut, after, follow = CUT if turn & 8 else 0, bounds[place + 1], AFTER[state][NEXT[state]]
            options = [(DELETE + after[state], DELETE, state, True), (INSERT + bounds[place][follow], INSERT, follow, False)]
            if not turn & 4:
                options.append((REROLE + cut + after[follow], REROLE + cut, follow, True))
                kept = AFTER[state][turn & 3]
                if kept >= 0:
                    options.append((KEEP + cut + after[kept], KEEP + cut, kept, True))
            _, paid, state, consumed = min(options, key=lambda o: (o[0], not o[3]))
            cost += paid
            if consumed:
                break
    while not ENDS[state]:
        state, cost = AFTER[state][NEXT[state]], cost + INSERT
    return cost


@lru_cache(maxsize=65536)
def remembered(turns: bytes) -> tuple[int, str]:
    return search(turns)


def repair(turns: bytes) -> tuple[int, str]:
    return remembered(turns) if len(turns) <= MEMO_TURNS else search(turns)


def with_faults(turns: DataFrame) -> DataFrame:
    """Add to ``turns(conv_id, turn, role, text)``, which have no nulls but in conv_id and
    turn, their digest, whether they are blank or cut off, and initial."""
    some = F.col("text").rlike(ANY)
    return turns.withColumns(
        {
            "digest": F.unhex(F.md5(F.col("text"))),
            "blank": ~some,
            "cut": some & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
            "initial": F.substring("role", 1, 1),
        }
    )


#: Nulls come first.
ORDER = ("turn", "role", "digest")


def repair_conversations(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per conv_id of ``ids``: what is wrong with the rows of ``turns(conv_id, turn,
    role, text)`` of that id and their cheapest repair.

    First the rows without their texts are sorted by conversation and turn, and each
    conversation's roles and faults are searched: a byte a row. Then the texts are sorted
    in the same way behind their conversation's audit, and streamed through the digest;
    no conversation's texts are ever held together and none is cut short. A null conv_id is a conversation
    too, a null turn is first, a null role or text is one space. Rows of one turn are
    ordered by role and the text's digest, and repeated rows count as duplicates. An
    empty role has no initial and can't be kept. Further columns are left out.
    """
    space = F.lit(" ")
    named = with_faults(turns.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")))
    small = named.select("conv_id", "turn", "role", "digest", "blank", "cut", "initial", F.lit(True).alias("row"))
    nothing = ids.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in small.columns[1:-1]], F.lit(False).alias("row"))
    same = Window.partitionBy("conv_id", "row", "role", "digest").orderBy("turn")
    placed = small.unionByName(nothing).repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    out = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def plan(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in out.split(", ")]
        key, state, rows = None, None, []

        def done():
            cost, audit = repair(bytes(state["turns"]))
            distinct, low, high = state["distinct"], state["low"], state["high"]
            gaps = high - low + 1 - distinct if distinct else 0
            return (key[0], gaps, *state["faults"], state["illegal"], cost, audit)

        def table_of(rows):
            types = [pa.int64()] * 7 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for conv, turn, row, again, blank, cut, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "row", "again", "blank", "cut", "initial")), strict=True):
                if key != (conv,):
                    if key is not None:
                        rows.append(done())
                    key, state = (conv,), {"turns": bytearray(), "distinct": 0, "low": None, "high": None, "faults": [0, 0, 0], "illegal": 0, "last": None}
                if not row:
                    continue
                if turn is not None and turn != state["high"]:
                    state["distinct"] += 1
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                if state["last"] is not None and state["last"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["last"] = initial
                fault = 0 if blank else 1 if again else 2 if cut else None
                if fault is not None:
                    state["faults"][fault] += 1
                state["turns"].append(ROLES.get(initial, OTHER) | (4 if fault in (0, 1) else 0) | (8 if fault == 2 else 0))
            if rows:
                yield table_of(rows)
                rows = []
        if key is not None:
            yield table_of([*rows, done()])

    sorted_rows = placed.sortWithinPartitions("conv_id", "row", *ORDER, "again").select("conv_id", "turn", "row", "again", "blank", "cut", "initial")
    plans = save(sorted_rows.mapInArrow(plan, out), "repairs")

    def digests(batches):
        import hashlib

        import pyarrow as pa

        names = [*[f.split()[0] for f in out.split(", ")], "repaired_sha256"]
        key, rows = None, []

        def said(role, text):
            nonlocal first
            digest.update((b"" if first else b"\n") + role + b":" + text)
            first = False

        def inserted():
            """Insertions before the next edit that takes a row; its initial."""
            nonlocal state, at
            while at < len(audit) and audit[at] == "I":
                said(NAMES[NEXT[state]].encode(), b"")
                state, at = AFTER[state][NEXT[state]], at + 1
            at += 1
            return audit[at - 1 : at]

        def table_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names], names=names)

        for batch in batches:
            for conv, found, role, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if found is not None:
                    if key is not None:
                        inserted()
                        rows.append(head | {"repaired_sha256": digest.hexdigest()})
                    key, head, audit, at, state, first, digest = (conv,), found | {"conv_id": conv}, found["audit"], 0, NOTHING, True, hashlib.sha256()
                    continue
                edit = inserted()
                if edit == "D":
                    continue
                follows = NEXT[state] if edit == "R" else ROLES.get(role[:1], OTHER)
                said((NAMES[follows] if edit == "R" else role).encode(), cell.as_py())
                state = AFTER[state][follows]
            if rows:
                yield table_of(rows)
                rows = []
        if key is not None:
            inserted()
            yield table_of([*rows, head | {"repaired_sha256": digest.hexdigest()}])

    found = F.struct(*[c for c in plans.columns if c != "conv_id"])
    heads = plans.select("conv_id", found.alias("found"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "binary"))], F.lit(False).alias("row"))
    texts = named.select("conv_id", F.lit(None).cast(heads.schema["found"].dataType).alias("found"), "turn", "role", "digest", F.col("text").cast("binary").alias("text"), F.lit(True).alias("row"))
    streamed = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "row", *ORDER).select("conv_id", "found", "role", "text")
    return streamed.mapInArrow(digests, f"{out}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with nulls as one space, by crc32 of conv_id and
    turn mod 20: dropped (0), emptied (1), without stops (2), twice (3), said by the
    user (4)."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    out = turns.withColumn("kind", kind).where("kind <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(rows), rows)


#: Plain form: after each row the best edits for each state are kept.
OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
         lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copies(i) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
  FROM damaged),
repeats AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again FROM placed),
faults AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM repeats),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
-- What a conversation has so far: '' nothing, s an opening, u a question, a an answer.
follow(state, initial, next) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts(state, next, paid, edits, lines) AS (VALUES
  ('', '', 0, '', []::VARCHAR[]), ('', 'u', 2, 'I', ['user:']), ('', 'a', 4, 'II', ['user:', 'assistant:']),
  ('s', 's', 0, '', []::VARCHAR[]), ('s', 'u', 2, 'I', ['user:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']),
  ('u', 'u', 0, '', []::VARCHAR[]), ('u', 'a', 2, 'I', ['assistant:']),
  ('a', 'a', 0, '', []::VARCHAR[]), ('a', 'u', 2, 'I', ['user:'])),
names(initial, role) AS (VALUES ('u', 'user'), ('a', 'assistant')),
edits AS (
  SELECT f.conv_id, f.place, w.state, w.next, CAST(f.fault = 'truncated' AS INTEGER) AS paid, 'K' AS edit, [f.role || ':' || f.text] AS lines
  FROM faults f JOIN follow w ON w.initial = f.initial WHERE f.fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.conv_id, f.place, w.state, w.next, 2 + CAST(f.fault = 'truncated' AS INTEGER), 'R', [m.role || ':' || f.text]
  FROM faults f, follow w JOIN names m ON m.initial = w.initial WHERE f.fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.conv_id, f.place, s.state, s.state, 3, 'D', []::VARCHAR[] FROM faults f, (SELECT DISTINCT state FROM inserts) s),
paths AS (
  SELECT conv_id, n, 0 AS place, '' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM facts
  UNION ALL
  SELECT conv_id, n, place, state, cost, audit, said FROM (
    SELECT p.conv_id, p.n, p.place + 1 AS place, e.next AS state, p.cost + i.paid + e.paid AS cost, p.audit || i.edits || e.edit AS audit, p.said || i.lines || e.lines AS said
    FROM paths p JOIN inserts i ON i.state = p.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.place = p.place + 1 AND e.state = i.next)
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
ends AS (
  SELECT p.conv_id, p.cost + i.paid AS cost, p.audit || i.edits AS audit, p.said || i.lines AS said
  FROM paths p JOIN inserts i ON i.state = p.state AND i.next IN ('', 'a') WHERE p.place = p.n
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + i.paid, p.audit || i.edits) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
