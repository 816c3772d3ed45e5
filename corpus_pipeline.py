"""A training-data pipeline over ``documents``: each stage works on all its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and
reread as the next stage's docs.  All but the last return the columns of documents, the
caller's own ones among them unchanged, whatever their names (results of operators go under
a prefix that no column has).  Null and empty texts pass the filtering stages: they have no
terms, shingles, windows or items.  A null doc_id is never a duplicate; rows that repeat a
doc_id are kept or go as the stage's rule says of each.  Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import _text as T
from lexspark.llm import bpe, decontaminate, near_dedup, substring_dedup, toxicity
from lexspark.llm.queries import TOKENIZER


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, each row by its own text; learned from the labels outside the
    held-out fifth.  Without labels nothing is toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~T.held_out(F.col("doc_id"), 5))
    x = T.unused(docs)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), prefix=x)
    return scored.where(F.col(f"{x}predicted") == 0).select(*T.columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8), the smallest doc_id stays; all
    rows of a doc_id go with it."""
    x = T.unused(docs)
    gone = near_dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(f"{x}gone"))
    return docs.join(gone, F.col("doc_id") == F.col(f"{x}gone"), "left_anti").select(*T.columns(docs))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a smaller doc_id has go from the texts; n_chars follows."""
    x = T.unused(docs)
    out = substring_dedup.dedup(docs, keep_text=True, prefix=x)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{x}n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*T.columns(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text."""
    x = T.unused(docs)
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix=x)
    return found.where(~F.col(f"{x}contaminated")).select(*T.columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row per row; null texts count as empty."""
    return bpe.encode(docs, TOKENIZER)


STAGES = [("toxicity", reject_toxic), ("near_dedup", near_duplicates), ("substring_dedup", repeated_substrings), ("decontaminate", benchmark_leaks), ("bpe", tokens)]

#: SQL cannot express the learned and the tokenising stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = T.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
