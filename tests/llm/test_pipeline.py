"""The pipeline's stages on a small table against plain versions."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import test_decontamination, test_line_dedup, test_ngram_join
from tidemark.llm.line_dedup import MIN_CHARS


def test_stages_and_run(spark, tmp_path):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(4)]
    rows = [(i, text(4)) for i in range(60)]
    rows += [(60 + i, "BUY!! " + "!! ".join(word().upper() for _ in range(20)) + "!!") for i in range(40)]
    long = [" ".join(word() for _ in range(30)) for _ in range(5)]
    rows += [(100 + i, " ".join([*long[i % 5].split()[:-1], word(), word()])) for i in range(10)]
    rows += [(110, text(1) + " " + items[0][1] + " " + text(1)), (111, rows[0][1]), (112, rows[1][1].split("\n")[0] + "\n" + text(2)), (113, None), (114, ""), (None, text(2))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60 or i >= 100), 0) for i in [*range(40), *range(60, 90)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    columns, at = docs.columns, docs
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()]
        after = stage(spark, at, str(tmp_path))
        after.write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert after.columns == columns, name
            got = sorted(((r.doc_id, r.text) for r in after.collect()), key=repr)
            assert all(r.n_chars == len(r.text or "") for r in after.collect())
        if k == 0:
            # A text without words is scored by the bias alone, which is low here.
            assert got == sorted((r for r in before if r[0] is None or not (60 <= r[0] < 100 or r[0] in (113, 114))), key=repr)
        elif k == 1:
            want = [(d, t) for d, t, _, e, n in test_line_dedup.brute(before, 2, MIN_CHARS) if not e + n or t.strip()]
            assert got == sorted(want, key=repr) and (111, "") not in got and len(got) < len(before)
        elif k == 2:
            comp = test_ngram_join.brute([r for r in before if r[0] is not None])
            assert got == sorted((r for r in before if r[0] is None or comp[r[0]][1] == r[0]), key=repr) and len(got) < len(before)
        elif k == 3:
            clean = {d for d, _, hit, _ in test_decontamination.brute(before, items, 10) if not hit}
            assert got == sorted((r for r in before if r[0] in clean), key=repr) and len(got) == len(before) - 1
        else:
            assert after.selectExpr("sum(length)").first()[0] == sum(r.doc_tokens for r in after.where("start = 0").collect())
            assert {r.doc_id for r in after.collect()} == {d for d, _ in before}
        at = after
    want = sorted(tuple(r) for r in at.selectExpr("coalesce(doc_id, -1)", "start", "length", "crc32(ids)").collect())
    assert sorted(tuple(r) for r in cp.run(spark, str(tmp_path)).selectExpr("coalesce(doc_id, -1)", "start", "length", "crc32(ids)").collect()) == want


def test_clashing_names_null_ids_and_types(spark, tmp_path):
    """Other columns come back as they were, whatever they are called; a null doc_id hides
    no benchmark passage; repeated rows of an id leave one."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(14))
    texts = {i: " ".join(word() for _ in range(30)) for i in range(30)}
    rows = [*texts.items(), (None, "see " + passage + " end"), (None, texts[3] + " own"), (None, None), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    names = ["score", "n_lines", "n_exact", "n_near", "__rows", "__gone", "__version", "a.b", "row", "id", "hit", "kept", "n", "of_doc", "gone", "lines", "at", "near"]
    docs = docs.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(names)], F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 5), 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {}
    for k, (name, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        found[k] = spark.read.parquet(f"{tmp_path}/out{k}")
        assert found[k].columns == docs.columns, name
        for r in found[k].collect():
            assert [r[c] for c in names] == list(range(len(names))) and r["map"] == {"k": 1}
    assert sorted(r.doc_id for r in found[2].where("doc_id is not null").collect()) == sorted(texts)
    kept = [(r.doc_id, r.text) for r in found[3].collect()]
    assert sorted(kept, key=repr) == sorted((r for r in rows if passage not in (r[1] or "")), key=repr)


def test_empty_tables(spark, tmp_path):
    """No documents give no rows; without benchmark or labels nothing is rejected."""
    docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == [], name
    for name, stage in cp.STAGES[:4]:
        assert sorted((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()) == [(1, "a few words"), (2, None)], name
