"""The corpus pipeline: quality classifier, near duplicates, benchmark items, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Every stage's result is written to the shared folder and read again.

Decisions go by a row's key and its own text, never by the key alone: rows that repeat a doc_id with another text stay or go by that
text, and of rows that share both one stays. Rows with a null doc_id are not dropped by the first three stages. Null and empty texts are
texts of no words. An empty table stays empty. Columns of other names are carried, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postsieve.llm import decontaminate, mixing, near_dedup, quality
from postsieve.llm.sharding import assign_shards
from postsieve.session import materialize

SHARDS = 40
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant accepts; it learns from the labels of the documents it is given."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, similarity 0.8)."""
    return near_dedup.one_of_each(docs, width=5, percent=80)


def keep_clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five words, containment 0.8)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them whole."""
    return mixing.mixed(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each row of the mix."""
    return assign_shards(docs, shards=SHARDS)


STAGES = [("quality", keep_quality), ("near duplicates", keep_one_of_each_group), ("benchmark", keep_clear_of_benchmark), ("source mix", mix_sources), ("shards", to_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
