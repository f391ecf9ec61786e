"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table

WINDOW = 10
#: Words of a near match may stand so many places off.
SLOP = 2
#: A shard of the index ends at so many documents or words.
SHARD_DOCS, SHARD_WORDS = 8192, 2_000_000


def _separators() -> bytes:
    """Lower-cases A-Z; every other ASCII byte but digits and a-z becomes a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item_id, terms) for every run of ``window`` words of an item; an item
    of fewer words, but not none, is one run. A null text has no words."""
    trans = _separators()

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().translate(trans).decode().split(" ")
                words = [w for w in words if w]
                for at in range(max(1, len(words) - window + 1)) if words else ():
                    ids.append(item)
                    terms.append(words[at : at + window])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(cut, "item_id string, terms array<string>")


def build_index(docs: DataFrame, gap: int) -> DataFrame:
    """Positional postings of all terms, in shards of whole documents.

    A row (shard, term, n, positions) holds a term's places in the shard, as
    int32 differences; a document begins ``gap`` places after its predecessor's
    end, so that no phrase reaches over. A row with a null term holds the shard's
    doc_ids and n_words.
    """
    import numpy as np

    trans = _separators()

    def index(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
        task, seq = TaskContext.get().partitionId(), 0

        def flush(number, chunks, doc_ids, sizes):
            shard = (task << 24) + seq
            yield pa.RecordBatch.from_pylist([{"shard": shard, "doc_ids": doc_ids, "n_words": sizes}], schema=schema)
            words = np.concatenate(chunks) if chunks else np.empty(0, np.int32)
            if not words.size:
                return
            starts = np.repeat(np.cumsum([0, *(n + gap for n in sizes[:-1])]) - np.cumsum([0, *sizes[:-1]]), sizes)
            order = np.argsort(words.astype(np.uint16) if len(number) < 65536 else words, kind="stable")
            places = (order + starts[order]).astype(np.int32)
            ends = np.cumsum(np.bincount(words, minlength=len(number)))
            firsts = np.concatenate([[0], ends[:-1]])
            steps = np.diff(places, prepend=np.int32(0))
            steps[firsts] = places[firsts]
            offsets = pa.py_buffer((4 * np.append(firsts, ends[-1])).astype(np.int32).tobytes())
            positions = pa.Array.from_buffers(pa.binary(), len(number), [None, offsets, pa.py_buffer(steps.astype(np.int32).tobytes())])
            nothing = pa.nulls(len(number), pa.list_(pa.int64()))
            columns = [pa.array(np.full(len(number), shard)), pa.array(list(number), pa.binary()).cast(pa.string()), pa.array(ends - firsts), positions, nothing, nothing]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

        number, chunks, doc_ids, sizes, total = {}, [], [], [], 0
        for batch in batches:
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (cell.as_py() or b"").translate(trans).split()
                if words:
                    chunks.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
                doc_ids.append(doc_id)
                sizes.append(len(words))
                total += len(words)
                if total >= SHARD_WORDS or len(sizes) >= SHARD_DOCS:
                    yield from flush(number, chunks, doc_ids, sizes)
                    number, chunks, doc_ids, sizes, total = {}, [], [], [], 0
                    seq += 1
        if sizes:
            yield from flush(number, chunks, doc_ids, sizes)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(index, "shard long, term string, n long, positions binary, doc_ids array<long>, n_words array<long>")


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Where windows of ``items(item_id, text)`` occur in ``docs(doc_id, text)``.

    Returns one row per row of ``docs``: doc_id, n_words, n_hit (words inside an
    exact occurrence), item_ids (items with one, as sorted strings), near_item_ids
    (items of which a window occurs so that, measured from its rarest term, each
    term is at most ``slop`` places from where the phrase has it; with 0 the same).

    The index of all terms of the documents is stored in the shared folder; what the
    windows' terms have in it is read from there. A window goes to the shards that hold
    its rarest term, by a join on that term; there the offset-adjusted lists of its
    terms are intersected from the rarest on.

    Null texts have no words; a null doc_id stays null; an item with a null
    item_id marks words but isn't listed; repeated items count once; repeated
    documents give a row each; without items or documents nothing is hit.
    Columns other than the named ones are ignored.
    """
    import numpy as np

    gap = window + slop + 1
    runs = save(item_windows(items, window), "windows").withColumn("wid", F.monotonically_increasing_id())
    vocabulary = runs.select(F.explode("terms").alias("term")).distinct()
    stored = save(build_index(docs, gap), "postings")
    index = save(stored.where("term is not null").join(vocabulary, "term", "left_semi").select(*stored.columns).unionAll(stored.where("term is null")), "asked-postings")

    counts = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("freq"))
    ranked = (
        runs.select("wid", "item_id", F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term"))
        .join(counts, "term")
        .groupBy("wid", "item_id", "length")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "at", "term"))).alias("ranked"))
        .where("size(ranked) = length")
        .select("item_id", "length", F.col("ranked.at").alias("offsets"), F.col("ranked.term").alias("terms"), F.col("ranked")[0]["term"].alias("term"))
    )
    asked = index.where("term is not null").select(F.col("shard").alias("asked_in"), "term").join(ranked, "term").drop("term")

    def search(key, postings, windows):
        import pyarrow as pa

        lists, doc_ids, sizes = {}, [], []
        for term, positions, ids, n in zip(*(postings.column(c).to_pylist() for c in ("term", "positions", "doc_ids", "n_words")), strict=True):
            if term is None:
                doc_ids, sizes = ids, n
            else:
                lists[term] = np.cumsum(np.frombuffer(positions, np.int32), dtype=np.int32)
        bases = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + gap)])
        cover = np.zeros(int(bases[-1]) + 1, np.int32)
        exact: list[set] = [set() for _ in sizes]
        near: list[set] = [set() for _ in sizes]
        for item, length, offsets, terms in zip(*(windows.column(c).to_pylist() for c in ("item_id", "length", "offsets", "terms")), strict=True):
            if any(t not in lists for t in terms):
                continue
            start = lists[terms[0]] - offsets[0]
            close = start
            for off, term in zip(offsets[1:], terms[1:], strict=True):
                run = lists[term]
                if start.size:
                    found = np.searchsorted(run, start + off)
                    start = start[run[np.minimum(found, run.size - 1)] == start + off]
                if slop and close.size:
                    found = np.searchsorted(run, close + (off - slop))
                    close = close[(found < run.size) & (run[np.minimum(found, run.size - 1)] <= close + (off + slop))]
            if start.size:
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length, -1)
                if item is not None:
                    for d in np.unique(np.searchsorted(bases, start, "right") - 1):
                        exact[d].add(item)
            if item is not None and close.size:
                first = close + offsets[0]
                for d in np.unique(np.searchsorted(bases, first, "right") - 1):
                    near[d].add(item)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
        hit = [int(inside[b + n] - inside[b]) for b, n in zip(bases[:-1], sizes, strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "n_words": pa.array(sizes, pa.int64()),
                "n_hit": pa.array(hit, pa.int64()),
                "item_ids": pa.array([sorted(x) for x in exact], pa.list_(pa.string())),
                "near_item_ids": pa.array([sorted(x) for x in near], pa.list_(pa.string())),
            }
        )

    return (
        index.groupBy("shard")
        .cogroup(asked.groupBy("asked_in"))
        .applyInArrow(search, "doc_id long, n_words long, n_hit long, item_ids array<string>, near_item_ids array<string>")
    )


def op1_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_item_ids").cast("long").alias("n_near_items"),
        F.sha2(F.concat_ws(",", "near_item_ids"), 256).alias("near_items_sha256"),
    )


#: Plain form: every document window is joined to the item windows by its words. Near
#: items: around each place of a window's rarest word, by its count in the documents and
#: then its place, every word of the window stands within two places of its own.
OP1_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid),
runs AS (SELECT row_number() OVER () AS wid, item_id, n, string_split(k, ' ') AS terms FROM win),
terms AS (SELECT wid, item_id, n, unnest(range(n)) AS place, unnest(terms) AS term FROM runs),
occ AS (SELECT * FROM (SELECT rid, unnest(range(len(w))) AS p, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM terms)),
freq AS (SELECT term, count(*) AS f FROM occ GROUP BY term),
rarest AS (SELECT wid, item_id, n, arg_min({'place': place, 'term': term}, {'f': f, 'place': place}) AS r
           FROM terms JOIN freq USING (term) GROUP BY wid, item_id, n HAVING count(*) = n),
starts AS (SELECT wid, item_id, n, rid, p - r.place AS base FROM rarest JOIN occ ON occ.term = r.term),
close AS (SELECT s.item_id, s.rid FROM starts s JOIN terms t ON t.wid = s.wid
          JOIN occ o ON o.rid = s.rid AND o.term = t.term AND o.p BETWEEN s.base + t.place - 2 AND s.base + t.place + 2
          GROUP BY s.item_id, s.wid, s.n, s.rid, s.base HAVING count(DISTINCT t.place) = s.n),
nears AS (SELECT rid, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM close WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, sha256(coalesce(nears.ids, '')) AS near_items_sha256
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid) LEFT JOIN nears USING (rid)
"""
