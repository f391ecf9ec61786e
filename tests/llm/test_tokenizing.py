"""Tokenizer helpers, token counts and packing against the libraries."""

import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.packing import binary_lengths, op8_power_of_two_packing, pack, write_buckets
from tidemark.llm.token_counts import count_tokens, op5_token_counts
from tidemark.llm.tokenizing import BytePieces, WordEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("aAbBzÉéßÀñİıǅª²½ .,!'’“\n\t\r\x0b\x0c\x85\xa0\x1c\x1f\x00\x7f0139-_…€") + ["'s", "'LL", "  ", " \n", "\n\n", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "ΑΣ ", "é", "中文", "🙂", "Å", " ", "﻿", "don't", " word", "Word"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    # Every kind of white space and control character, alone and together.
    blank = [*map(chr, range(0x21)), "\x7f", "\x85", "\xa0", "\u2028", "\u2029", "\u3000"]
    made += ["".join(rnd.choice(blank) for _ in range(rnd.randint(1, 6))) for _ in range(3000)] + blank
    return [*made, "", " ", "\n", "   x", "x   ", "a" * 50_000, "word " * 20_000]


def test_word_ids_equal_the_library(texts):
    own, lib = WordEncoder(WORD), Tokenizer.from_file(WORD)
    for text in texts:
        want = b"".join(i.to_bytes(4, "little") for i in lib.encode(text, add_special_tokens=False).ids)
        assert own.ids(text) == want, repr(text[:200])


def test_byte_counts_equal_the_library(texts):
    own, lib = BytePieces(BYTE), Tokenizer.from_file(BYTE)
    for text in texts:
        want = len(lib.encode(text, add_special_tokens=False).ids)
        assert sum(n * own.count(p) for p, n in own.frequencies(text).items()) == want, repr(text[:200])


def test_memos_stay_right_when_emptied(monkeypatch, texts):
    monkeypatch.setattr("tidemark.llm.tokenizing.MEMO_ENTRIES", 3)
    test_word_ids_equal_the_library(texts[:300])
    test_byte_counts_equal_the_library(texts[:300])


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, "twice", None, 2), (3, "twice", None, 2), (None, "no id", None, None), (9000, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int").repartition(5)


@pytest.mark.parametrize("buckets", [None, 1])
def test_count_tokens(spark, docs, buckets):
    lib = Tokenizer.from_file(BYTE)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in count_tokens(docs, BYTE, buckets).collect())
    assert got == want
    assert count_tokens(docs.where("false"), BYTE).count() == 0


def test_binary_lengths():
    for n in range(1, 300):
        parts = binary_lengths(n, 64)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 64 for p in parts) and parts == sorted(parts, reverse=True)


def test_pack_keeps_every_id_once(spark, docs):
    lib = Tokenizer.from_file(WORD)
    pieces = pack(docs, WORD, max_length=64).withColumn("crc", F.crc32("ids")).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and {p.offset for p in pieces} == {0}
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= 64 and len(p.ids) == 4 * p.length and p.crc == zlib.crc32(p.ids)
    for doc_id, text in ((5, None), (3, "twice"), (None, "no id"), (9000, None)):
        mine = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        text = text or next((r.text for r in docs.where(F.col("doc_id").eqNullSafe(doc_id)).collect() if r.text), "")
        if doc_id == 3:
            mine = [p for p in mine if p.doc_tokens == len(lib.encode("twice", add_special_tokens=False).ids) + 1]
            assert len(mine) % 2 == 0
            continue
        want = lib.encode(text, add_special_tokens=False).ids + [2]
        body = b"".join(p.ids for p in mine)
        assert [int.from_bytes(body[i : i + 4], "little") for i in range(0, len(body), 4)] == want
        assert all(p.doc_tokens == len(want) for p in mine)
    assert pack(docs.where("false"), WORD).count() == 0


def test_every_id_of_every_document_and_buckets(spark, docs, tmp_path):
    lib = Tokenizer.from_file(WORD)
    once = docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null and doc_id <> 3")
    write_buckets(pack(once, WORD, max_length=64), f"{tmp_path}/buckets")
    found = spark.read.parquet(f"{tmp_path}/buckets")
    assert {r.length for r in found.select("length").distinct().collect()} <= {1 << k for k in range(7)}
    made = {}
    for r in found.orderBy("doc_id", "start").collect():
        assert r.start == len(made.setdefault(r.doc_id, b"")) // 4 and len(r.ids) == 4 * r.length
        made[r.doc_id] += r.ids
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 2] for r in once.collect()}
    assert made == {k: b"".join(i.to_bytes(4, "little") for i in v) for k, v in want.items()}


def test_long_repeats_are_summed(spark):
    docs = spark.createDataFrame([(1, "x x " * 70_000), (2, ""), (3, "x y"), (4, None), (5, "y")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, BYTE).collect()}
    library = Tokenizer.from_file(BYTE)
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_query_op5_on_the_given_table(spark):
    lib, sf = Tokenizer.from_file(BYTE), "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        want[r.doc_id] = (len(text.encode()), n, n > 512)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op5_token_counts(spark, sf).collect()} == want


def test_query_op8_on_the_given_table(spark):
    lib, sf = Tokenizer.from_file(WORD), "/root/testdata/sf0.001"
    ids = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_power_of_two_packing(spark, sf).collect()
    covered: dict = {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece)) and r.doc_tokens == len(ids[r.doc_id])
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and len(piece) == r.length <= 4096
        covered.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {d: sorted(c) for d, c in covered.items()} == {d: list(range(len(i))) for d, i in ids.items()}
    assert len({r.sequence_id for r in rows}) == len(rows)
