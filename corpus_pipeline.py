"""The corpus pipeline: quality rules, exact dedup, near-dedup, substring dedup, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.exact_dedup import keep_first_copies
from pagewright.llm.packing import best_fit_packing
from pagewright.llm.quality_rules import keep_quality
from pagewright.llm.queries import WORD_TOKENIZER
from pagewright.llm.simhash_dedup import keep_one_of_each
from pagewright.llm.substring_dedup import keep_rest
from pagewright.scratch import delete, scratch, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rest(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("substring dedup", substring), ("best-fit packing", packing)]

#: Tokenizer ids and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's scratch tables go when its result is written, and the
    result goes when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
