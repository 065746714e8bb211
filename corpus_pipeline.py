"""The corpus pipeline: from raw documents to sharded training data, each stage by one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch.llm import decontaminate, mixing, quality, sharding, simhash
from movewatch.llm.common import free_name, table, word_count
from movewatch.session import materialized

QUALITY_LEAST = 0.3
SHINGLE_WORDS = 5
MIX_WEIGHTS, MIX_MOST, MIX_SEED = (5, 2, 1), 3.0, 42
SHARDS = 8

#: The stages learn from labels, link by fingerprints and search with edits: no SQL says that.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"), QUALITY_LEAST)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs, SHINGLE_WORDS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, whole."""
    # as one column, the documents can't clash with the columns of the mix
    whole = docs.select(F.struct("*").alias("doc"), F.col("source"), word_count(F.col("text")).alias("words"))
    identity = [F.col("doc.doc_id"), F.md5("doc.text")]
    taken = mixing.mix(whole, F.col("words"), MIX_WEIGHTS, MIX_MOST, MIX_SEED, identity=identity)
    return mixing.repeated(taken).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    digest = free_name(docs, "_digest")
    placed = sharding.assign(docs.withColumn(digest, F.xxhash64("text")), SHARDS, ("doc_id", digest))
    return placed.drop(digest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
