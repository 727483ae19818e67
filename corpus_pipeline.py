"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.  All stages but the
last return the columns of ``documents``; the last returns each row's shard and slot.

Null and empty texts are rejected by the first stage; an empty table passes through every stage;
rows are compared, counted and drawn one by one when they repeat; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankfold.llm import decontam, mixing, ngram_join, quality, sharding
from rankfold.session import configure_session, materialize

SHARDS = 8

#: MinHash banding decides which pairs are verified; SQL cannot express it (tests/llm compares
#: the stages with brute force instead)
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    configure_session(spark)
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    configure_session(spark)
    return ngram_join.one_of_each_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    configure_session(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    configure_session(spark)
    return mixing.mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    configure_session(spark)
    return sharding.assign_shards(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    configure_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
