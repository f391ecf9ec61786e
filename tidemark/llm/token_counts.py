"""Token counts from piece counts of distinct pre-tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SHARD_DOCS, SHARD_BYTES = 16_384, 32 << 20


def count_tokens(docs: DataFrame, tokenizer_path: str, buckets: int | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one per row of ``docs(doc_id, text)``.

    1. Each task turns its documents, in shards of bounded size, into pre-token
       frequencies: per shard and hash bucket the distinct pre-tokens with the
       documents that hold them and how often.
    2. Dealt by bucket, a pre-token's pieces are counted once and joined to its
       frequencies; what comes out are sums per shard and document. A pre-token in
       more than one of 16 documents of its shard is dealt by shard as well, so
       none fills a bucket.
    3. Dealt by shard, the sums of a document are added.
    No token ids are made. A null or empty text has 0 bytes and 0 tokens; a null
    doc_id stays null; repeated rows are counted once each; no rows give no rows.
    """
    import numpy as np

    spark = docs.sparkSession
    n_buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = "bucket int, shard long, tokens binary, df binary, docs binary, freq binary, doc_ids array<long>, n_bytes array<long>"

    def shards(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        from tidemark.llm.tokenizing import byte_pieces

        pieces = byte_pieces(tokenizer_path)
        task, seq = TaskContext.get().partitionId(), 0
        fields = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("tokens", pa.binary()), ("df", pa.binary()), ("docs", pa.binary()), ("freq", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))])

        def flush(shard, number, tids, freqs, lens, doc_ids, sizes):
            rows = [(int(zlib.crc32(shard.to_bytes(8, "little")) % n_buckets), shard, None, None, None, None, doc_ids, sizes)]
            if tids:
                tid, freq = np.array(tids, np.int32), np.array(freqs, np.int64)
                doc = np.repeat(np.arange(len(lens), dtype=np.uint16), lens)
                while (big := np.flatnonzero(freq > 65535)).size:  # a cell holds 16 bits
                    tid, doc, freq = np.append(tid, tid[big]), np.append(doc, doc[big]), np.append(freq, freq[big] - 65535)
                    freq[big] = 65535
                words = [w.encode() for w in number]
                df = np.bincount(tid, minlength=len(words)).astype(np.uint32)
                hot = df > max(64, len(doc_ids) // 16)
                salt = shard.to_bytes(8, "little")
                bucket = np.fromiter((zlib.crc32(w + salt if h else w) % n_buckets for w, h in zip(words, hot, strict=True)), np.int64, len(words))
                by_bucket = np.argsort(bucket, kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[by_bucket] = np.arange(len(words))
                order = np.argsort(rank[tid], kind="stable")
                doc, freq = doc[order], freq[order].astype(np.uint16)
                ends = np.concatenate([[0], np.cumsum(df[by_bucket], dtype=np.int64)])
                cuts = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
                for b in range(n_buckets):
                    lo, hi = cuts[b], cuts[b + 1]
                    if lo < hi:
                        s, e = ends[lo], ends[hi]
                        mine = by_bucket[lo:hi]
                        rows.append((b, shard, b"\xff".join([words[i] for i in mine]), df[mine].tobytes(), doc[s:e].tobytes(), freq[s:e].tobytes(), None, None))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

        number, tids, freqs, lens, doc_ids, sizes, held = {}, [], [], [], [], [], 0
        for batch in batches:
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py() or ""
                found = pieces.frequencies(text)
                tids += [number.setdefault(p, len(number)) for p in found]
                freqs += found.values()
                lens.append(len(found))
                doc_ids.append(doc_id)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                held += sizes[-1]
                if held >= SHARD_BYTES or len(lens) >= SHARD_DOCS:
                    yield flush((task << 24) + seq, number, tids, freqs, lens, doc_ids, sizes)
                    number, tids, freqs, lens, doc_ids, sizes, held = {}, [], [], [], [], [], 0
                    seq += 1
        if lens:
            yield flush((task << 24) + seq, number, tids, freqs, lens, doc_ids, sizes)

    def counted(batches):
        import pyarrow as pa

        from tidemark.llm.tokenizing import byte_pieces

        pieces = byte_pieces(tokenizer_path)
        names = ["shard", "docs", "sums", "doc_ids", "n_bytes"]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["doc_ids"] is not None:
                    out.append((row["shard"], None, None, row["doc_ids"], row["n_bytes"]))
                    continue
                n = np.array([pieces.count(w.decode()) for w in row["tokens"].split(b"\xff")], np.int64)
                each = np.repeat(n, np.frombuffer(row["df"], np.uint32)) * np.frombuffer(row["freq"], np.uint16)
                doc = np.frombuffer(row["docs"], np.uint16)
                sums = np.bincount(doc, weights=each)  # exact below 2**53
                some = np.flatnonzero(sums)
                out.append((row["shard"], some.astype(np.uint16).tobytes(), sums[some].astype(np.int64).tobytes(), None, None))
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    def added(table):
        import pyarrow as pa

        ids, sizes, total = [], [], None
        rows = table.to_pylist()
        for row in rows:
            if row["doc_ids"] is not None:
                ids, sizes = row["doc_ids"], row["n_bytes"]
        total = np.zeros(len(ids), np.int64)
        for row in rows:
            if row["docs"] is not None:
                total[np.frombuffer(row["docs"], np.uint16)] += np.frombuffer(row["sums"], np.int64)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total)})

    freq = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shards, cells)
    sums = freq.repartition("bucket").mapInArrow(counted, "shard long, docs binary, sums binary, doc_ids array<long>, n_bytes array<long>")
    return sums.groupBy("shard").applyInArrow(added, "doc_id long, n_bytes long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
