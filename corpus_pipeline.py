"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm import exact_dedup, near_dedup, packing, quality, span_dedup
from siterank.llm.common import BLANK, stage, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject; its model is learned from the documents given."""
    scored = quality.score_quality(docs, score_col="__quality")
    return scored.filter(F.col("__quality") >= quality.KEEP_FROM).drop("__quality")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest id; decided by id and text, so null and repeated ids are no exception."""
    answer = exact_dedup.exact_duplicates(docs)
    texts = answer.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.bool_or("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")).filter("__kept")
    plain = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANK, " ")
    hashed = docs.withColumns({"__own": F.col("doc_id").cast("long"), "__hash": F.sha2(plain, 256)})
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__sha"))
    once = hashed.join(texts.filter("__rows = 1"), same, "left_semi")
    if not texts.filter("__rows > 1").isEmpty():
        once = once.unionByName(hashed.join(texts.filter("__rows > 1"), same, "left_semi").dropDuplicates(["__own", "__hash"]))
    return once.drop("__own", "__hash")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: at least 80 % of all shingles of 5 words shared (op5 alone asks 85 %).

    Rows of one id are one document and stay or go together; rows without id stay.
    """
    kept = near_dedup.near_duplicates(docs, percent=80).filter("kept").select(F.col("doc_id").alias("__id"))
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in an earlier one; ``n_chars`` follows the text."""
    cut = span_dedup.remove_repeats(docs, removed_col="__removed").drop("__removed")
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", drop_low_quality), ("exact dedup", drop_exact_copies), ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages), ("best-fit packing", pack),
]

#: SQL can't express the classifier, token ids or packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
