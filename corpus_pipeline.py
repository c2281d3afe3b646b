"""The corpus pipeline: five operators one after another, each over what its predecessor kept.

Toxic documents go, then exact copies, then all but one of each group of near copies, then passages that repeat; what
is left is packed into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import exact_dedup, near_copies, packing, substring_dedup, toxicity
from tallyloom.llm.shared import new_path, remove


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the machine trained on the labels of sf_dir scores 0.5 or more; null and empty texts stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space (null: empty), the row with the smallest doc_id; nulls last."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id; texts without words are one group."""
    return near_copies.one_of_each(docs, width=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the words of windows of 20 that start earlier too; null and empty texts as they were."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in sequences of 1024 tokens; null and empty texts are the end mark alone."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]

#: Classifying, near copies and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written and read again as the next one's documents.

    A stage's table is deleted once its successor has been written; the last one's input stays, as the result may read it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(before, spark)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
