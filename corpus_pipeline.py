"""Five stages that turn `documents` into packed sequences, each a corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rhetree.llm.common import new_path, table
from rhetree.llm.near_join import near_filter
from rhetree.llm.packing import packing_digest
from rhetree.llm.quality import quality_filter
from rhetree.llm.secrets import redact
from rhetree.llm.substring_dedup import substring_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    return quality_filter(docs)


def near_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_filter(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut out of the texts."""
    return substring_filter(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts with their places in sequences."""
    return packing_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_join", near_join),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: SQL has no tokenizer and no MinHash: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
