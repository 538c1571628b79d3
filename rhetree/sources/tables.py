"""Predictions and folds as rows: what the writers write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetree.functions.columns import UNRELATED, name_of


def prediction_rows(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """A row per pair with its predicted label, UNRELATED where there is none."""
    key = ["grouping", "parent", "child"]
    label = F.coalesce("_label", F.lit(UNRELATED))
    named = triples.select(*key, F.col("label").alias("_label")).dropDuplicates(key)
    return pairs.join(named, key, "left").withColumn("label", label).drop("_label")


def gold_predictions(pairs: DataFrame, labels: Sequence[str], folds: DataFrame | None = None) -> DataFrame:
    """The targets as predictions of all pairs; with `folds` also the fold of each."""
    out = pairs.select("grouping", "parent", "child", name_of(F.col("target"), labels).alias("label"))
    return out if folds is None else out.join(folds, "grouping")
