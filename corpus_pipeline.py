"""A training-data pipeline over `documents`: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder
and hands the reread table to the next stage, so a lost executor costs part of one stage at most. Stages but
the last return the columns of their input. Empty tables, nulls and repeated rows are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, near_dup, quality_rules, sharding
from quern.sources.scratch import Scratch

#: Words of a shingle in the near-dedup stage; the contract of op8 alone asks for two.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return near_dup.drop_near_copies(docs, shingle=SHINGLE)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target words."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, which replace columns of these names."""
    placed = sharding.assign_shards(docs, keep=True)
    new = {"shard": placed["shard"], "slot": placed["slot"], "shard_bytes": placed["size"]}
    old = [placed["row"][c].alias(c) for c in docs.columns if c.lower() not in new]
    return placed.select(*old, *(v.alias(k) for k, v in new.items()))


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: Near-duplicate groups, entropy-balanced rates and sampled splitters have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(last)
        last = docs
    return docs
