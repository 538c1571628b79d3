"""Cross-validation folds of groupings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import new_table


def make_folds(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(grouping, fold): groupings in a seeded random order, dealt to n folds in turn.

    Fold sizes differ by one at most. Raises unless 2 <= n <= groupings. Ranks are taken
    in buckets of the random key, so only the counts of 4096 buckets are ordered as a whole.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "grouping"))
    groups = rows.select("grouping").distinct().withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 3))
    counts = groups.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if not 2 <= n <= total:
        raise ValueError(f"{n} folds for {total} groupings")
    ahead = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_b", F.coalesce(ahead, F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_k", "grouping")) - 1
    return groups.join(offsets, "_b").select("grouping", ((F.col("_first") + rank) % n).cast("int").alias("fold"))


def fold_groupings(folds: DataFrame, fold: int) -> DataFrame:
    """The groupings of a fold; raises if there are none."""
    own = folds.where(F.col("fold") == fold).select("grouping")
    if own.isEmpty():
        raise ValueError(f"no grouping in fold {fold}")
    return own


def test_rows(rows: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    return rows.join(folds.where(F.col("fold") == fold), "grouping", "left_semi")


def train_rows(rows: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    return rows.join(folds.where(F.col("fold") != fold), "grouping", "left_semi")


Config = Callable[[DataFrame, DataFrame], DataFrame]


def cross_validate(
    pairs: DataFrame, folds: DataFrame, configs: dict[str, Config], path: str | None = None, threads: int = 4, test: DataFrame | None = None,
) -> DataFrame:
    """Predictions of each configuration on each fold, learned on the others: adds config and fold.

    A configuration maps (training rows, test rows) to the test rows with predictions. Each
    (config, fold) is a job that writes its own folder under `path` (or in the shared
    folder); `threads` jobs run at a time, and Spark shares the executors among them. Jobs
    whose folder is complete are not run again, so that a run that broke off goes on
    where it ended; `manifest` lists them. With `test` each configuration also learns
    from all pairs and predicts those rows, under a null fold.
    """
    spark = pairs.sparkSession
    root = path or new_table(spark, "folds")
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    jobs = [(name, fold) for fold in numbers for name in configs] + [(name, None) for name in configs if test is not None]

    def run(name: str, fold: int | None) -> DataFrame:
        place = f"{root}/config={name}/fold={'all' if fold is None else fold}"
        if not _complete(spark, place):
            began = time.time()
            train, rows = (pairs, test) if fold is None else (train_rows(pairs, folds, fold), test_rows(pairs, folds, fold))
            configs[name](train, rows).write.mode("overwrite").parquet(place)
            entry = {"config": name, "fold": fold, "path": place, "n_rows": spark.read.parquet(place).count(), "seconds": round(time.time() - began, 3)}
            _write(spark, f"{root}/_manifest/{name}-{'all' if fold is None else fold}.json", json.dumps(entry))
        return spark.read.parquet(place).withColumns({"config": F.lit(name), "fold": F.lit(fold).cast("int")})

    with ThreadPoolExecutor(threads) as pool:
        # tables that jobs write belong to the operator around this one, in whatever thread
        waiting = [pool.submit(copy_context().run, inheritable_thread_target(spark)(run), *job) for job in jobs]
        parts = [w.result() for w in waiting]
    return reduce(DataFrame.unionByName, parts)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(config, fold, path, n_rows, seconds) of the jobs that have ended under `path`; fold is null for those that learned from all."""
    return spark.read.schema("config string, fold int, path string, n_rows long, seconds double").json(f"{path}/_manifest/*.json")


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in whatever file system the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def _complete(spark, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
