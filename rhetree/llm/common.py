"""Helpers shared by the corpus operators: reading tables and writing intermediate ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rhetree.operators.storage import concluded, deleted, new_path, scratch, shared_dir, written

__all__ = ["BUCKETS", "HOT", "concluded", "deleted", "in_buckets", "new_path", "scratch", "shared_dir", "spread_join", "table", "text_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Buckets of a key that a semi-join is reduced by; what is broadcast has as many rows at most.
BUCKETS = 1 << 18


def in_buckets(rows: DataFrame, wanted: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key falls in a bucket of a wanted key (`left_anti`: in none).

    A filter before a join on `key`: it lets all wanted rows pass and few others, so that
    the others are not shuffled. Only bucket numbers are broadcast, BUCKETS at most.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    some = wanted.select(bucket(key).alias("_bucket")).distinct()
    return rows.withColumn("_b", bucket(key)).join(F.broadcast(some), F.col("_b") == F.col("_bucket"), how).drop("_b", "_bucket")


#: Keys that hold more than one row in so many are hot; there are fewer of them than that.
HOT = 10_000


def spread_join(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of `rows` with one row per key of `values`; no task gets all rows of a hot key.

    `weight` is a column of `values`: how many of the `total` rows a key has. Keys of more
    than total / HOT rows are fewer than HOT, so they are broadcast, and their rows stay
    where they are; the others are shuffled. Null keys match nothing.
    """
    hot = F.broadcast(values.where(F.col(weight) > total // HOT).drop(weight))
    cold = values.where(F.col(weight) <= total // HOT).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
