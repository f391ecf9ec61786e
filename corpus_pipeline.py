"""Corpus preparation: filter, de-duplicate, decontaminate and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``. Whole texts are taken, however long.
Rows with a null doc_id stay unless their text is contaminated, null and empty texts
unless the classifier rejects them; empty tables give empty tables. Further columns of
any name and type stay as they are, but for ``n_chars`` where lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, ngram_join, packing, quality
from tidemark.llm.common import as_row, quoted, save, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, scores 0.7 or more.
    Without any labels nothing is rejected."""
    weights = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    if not weights.any():
        return docs
    rows = docs.select("text", as_row(docs).alias("row"))
    return quality.score(rows, weights).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, exact copies of any length
    and near copies of longer lines; a document of which nothing
    but white space is left, and something was dropped, goes."""
    out = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", as_row(docs).alias("row")))
    dropped = F.col("n_exact") + F.col("n_near") > 0
    out = out.where(~dropped | F.coalesce(F.length(F.trim(F.translate("text", "\n\r\t", "   "))) > 0, F.lit(False)))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(dropped, F.length("text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(name) for name, c in own.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram similarity joins, the one with the smallest doc_id.
    Rows with a null doc_id stay; of rows with equal doc_id the one with the smallest
    text (then by the hash of all columns) stays."""
    found = save(ngram_join.jaccard_components(docs.select("doc_id", "text")), "components")
    keep = save(found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    rows = docs.select(F.col("doc_id").alias("id"), as_row(docs).alias("row")).join(keep.withColumnRenamed("doc_id", "kept"), F.col("id") == F.col("kept"))
    order = F.struct(F.coalesce(F.col("row.text"), F.lit("")), F.xxhash64(F.to_json("row")))
    again = rows.where("n > 1").groupBy("kept").agg(F.min_by("row", order).alias("row"))
    return rows.where("n = 1").select("row.*").unionAll(again.select("row.*")).unionAll(docs.where("doc_id is null").select(*[quoted(c) for c in docs.columns]))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside any window of a benchmark item. Rows with a null
    doc_id are judged by their texts, under numbers of their own."""
    items = table(spark, sf_dir, "benchmark")
    found = decontamination.find_items(docs.select("doc_id", "text"), items)
    hit = save(found.where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias("hit")).distinct(), "contaminated")
    rows = docs.select(F.col("doc_id").alias("id"), "text", as_row(docs).alias("row"))
    clean = rows.where("id is not null").join(hit, F.col("id") == F.col("hit"), "left_anti")
    unnamed = rows.where("id is null")
    if not unnamed.isEmpty():
        texts = save(unnamed.where("text is not null").select("text").distinct().select(F.monotonically_increasing_id().alias("doc_id"), "text"), "unnamed-texts")
        marked = decontamination.find_items(texts, items).where("n_hit > 0").select("doc_id")
        unnamed = unnamed.join(save(texts.join(marked, "doc_id").select(F.col("text").alias("hit")), "contaminated"), F.col("text") == F.col("hit"), "left_anti")
    return clean.unionAll(unnamed).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces of power-of-two lengths, one sequence each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]
#: Stages 1 and 5 have no SQL; tests/llm/test_pipeline.py holds the stages against
#: plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{k}")
    return docs
