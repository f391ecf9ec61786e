"""Packing by power-of-two decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

MAX_LENGTH = 4096
END_ID = 2


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to ``n``, none above ``longest``, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Cut each document into pieces of power-of-two lengths; every piece is a
    sequence of its own, so no sequence crosses documents and none is padded.

    ``docs``: ``doc_id`` and ``text``; other columns are ignored. Returns one row
    per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id, offset. Sequences of equal ``length`` batch together
    (``write_buckets``). ``max_length`` must be a power of two.

    A null or empty text is the end id alone; a null doc_id stays null; repeated
    rows are packed once each; an empty table gives no rows. There is no shuffle:
    a piece's sequence id is its number in the partition of its document, which a lost
    task makes again as it was.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        from tidemark.llm.tokenizing import word_encoder

        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            ids, starts, lengths, bodies, totals = [], [], [], [], []
            held = 0

            def flush():
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(bodies, pa.binary()), pa.array(totals, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = encoder.ids(text.as_py() or "") + end
                n, at = len(body) // 4, 0
                for length in binary_lengths(n, max_length):
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(length)
                    bodies.append(body[4 * at : 4 * (at + length)])
                    totals.append(n)
                    at += length
                held += len(body)
                if held > 1 << 24:
                    yield flush()
                    ids, starts, lengths, bodies, totals = [], [], [], [], []
                    held = 0
            if ids:
                yield flush()

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces in one folder per length, so that a reader batches equal lengths."""
    pieces.write.partitionBy("length").parquet(path)


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
