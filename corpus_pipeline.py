"""The pipeline over documents: toxicity, quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written
as Parquet and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import near_duplicates, packing, quality, substrings, toxicity
from tallyline.llm.frames import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold; the model learns from labels outside the held-out quarter."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rule and their compression bands."""
    return quality.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents linked by shingles of five words at 0.8 or more."""
    return near_duplicates.keep_one(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words of 20-word windows that start earlier in the corpus too."""
    return substrings.remove_repeats(docs, size=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens along the curve."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("quality_rules", keep_good), ("near_duplicates", keep_one_of_each_group),
    ("substring_dedup", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL can express the model, the compression bands and the curve; tests/llm holds the stages against brute force.
ORACLE_SQL = None
