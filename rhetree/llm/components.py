"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One round: neighbours move to the smallest node they can see. Edges have a > b."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, what: str = "links") -> DataFrame:
    """(node, component) of every node that is not the smallest of its component.

    `edges` has two columns of one orderable type; loops and rows with nulls are left
    out, repeats do no harm. Each round is written to the shared folder; the rounds end
    when one leaves the edges as they were. A node's links are only ever joined and
    summed up, never gathered.
    """
    a, b = edges.columns
    ordered = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now, before = written(ordered, what), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, now = seen, written(_stars(now), what)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for the nodes 0 to n - 1 of one task."""
    own = np.arange(n)
    while True:
        low = np.minimum(own[a], own[b])
        new = own.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, own):
            return own
        own = new
