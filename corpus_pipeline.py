"""From raw documents to shards: quality, near-duplicates, contamination, source weights, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``; the last adds the shard and the slot of each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stamina.llm import crf_quality, decontamination, mixing, ngram_join, sharding
from stamina.llm.common import read
from stamina.session import ensure_checkpoint_dir, ship

SHARDS = 24

#: Line marginals and hypergeometric draws are beyond SQL; tests/llm checks the pipeline stage by stage.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship()
    return crf_quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship()
    return ngram_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship()
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship()
    return mixing.mix(docs, mixing.cycle_weights)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship()
    placed = sharding.shard(docs.drop("shard", "slot"), SHARDS)        # columns that came with these names give way
    return placed.withColumnRenamed("__shard", "shard").withColumnRenamed("__slot", "slot").drop("__size")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result kept in the shared folder for the next."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
