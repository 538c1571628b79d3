"""Decoders that are plain DataFrame operations, and numbers for the search decoders.

A decoder takes weights and returns them with `prediction`: the best label's number for a
link, UNRELATED otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetree.functions.columns import best_label

from .pairs import sorted_units
from .storage import large


def _predict(weights: DataFrame, chosen: Column, unrelated: int) -> DataFrame:
    label = best_label(F.col("label_w")) if "label_w" in weights.columns else F.lit(0)
    return weights.withColumn("prediction", F.when(F.coalesce(chosen, F.lit(False)), label).otherwise(F.lit(unrelated)))


def decode_threshold(weights: DataFrame, unrelated: int, threshold: float | None = 0.5) -> DataFrame:
    """Links whose weight is over the threshold; None for scores that are not probabilities: over 0."""
    return _predict(weights, F.col("attach") > (0.0 if threshold is None else threshold), unrelated)


def decode_last(weights: DataFrame, units: DataFrame, unrelated: int) -> DataFrame:
    """Each unit hangs from the one before it in reading order, the first from ROOT."""
    order = sorted_units(weights, units)
    after = Window.partitionBy("grouping").orderBy("rank")
    steps = order.select("grouping", F.col("id").alias("parent"), F.lead("id").over(after).alias("child"), F.lit(True).alias("_next"))
    marked = weights.join(steps.where("child IS NOT NULL"), ["grouping", "parent", "child"], "left")
    return _predict(marked, F.col("_next"), unrelated).drop("_next")


def decode_as_many(weights: DataFrame, unrelated: int) -> DataFrame:
    """The N best pairs of a grouping, N being its units (ROOT counts where pairs name it)."""
    n = weights.select("grouping", F.explode(F.array("parent", "child")).alias("id")).distinct()
    n = n.groupBy("grouping").agg(F.count(F.lit(1)).alias("_n"))
    best = F.row_number().over(Window.partitionBy("grouping").orderBy(F.desc("attach"), "pair_ix"))
    ranked = weights.withColumn("_rank", best).join(n, "grouping")
    return _predict(ranked, F.col("_rank") <= F.col("_n"), unrelated).drop("_rank", "_n")


def decode_best_incoming(weights: DataFrame, unrelated: int) -> DataFrame:
    """The best parent of each child, the first on ties."""
    best = weights.groupBy("grouping", "child").agg(F.max_by("pair_ix", F.struct("attach", -F.col("pair_ix"))).alias("_best"))
    marked = weights.join(best, ["grouping", "child"])
    return _predict(marked, F.col("pair_ix") == F.col("_best"), unrelated).drop("_best")


def neighbours(units: DataFrame, key: Sequence[str] = ("grouping",)) -> DataFrame:
    """(key, one, two) in both orders: no third unit lies between, or one holds the other.

    No units are paired but those that may overlap. Of units apart, one's only possible
    neighbour after it is the unit whose start is the next place at which any other unit
    begins or ends, if no further one does so there. Units that overlap lie in one run of
    units that start before the furthest end so far.
    """
    own = list(key)
    spans = units.select(*own, "id", F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    places = spans.select(*own, "id", "s", F.explode(F.array_distinct(F.array("s", "e"))).alias("x"))
    at = places.groupBy(*own, "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "s")).alias("u"), F.max(F.struct("id", "s")).alias("v"))
    ahead = Window.partitionBy(*own).orderBy("x")
    at = at.withColumn("_next", F.lead(F.struct("x", "n", "u")).over(ahead))
    here = spans.join(large(at.withColumnRenamed("x", "e")), [*own, "e"])
    # at the unit's own end: itself and perhaps others; else the next place
    other = F.when(F.col("u.id") == F.col("id"), F.col("v")).otherwise(F.col("u"))
    after = F.when((F.col("n") == 2) & (other["s"] == F.col("e")), other["id"]).when(
        (F.col("n") == 1) & (F.col("_next.n") == 1) & (F.col("_next.u.s") == F.col("_next.x")), F.col("_next.u.id")
    )
    apart = here.select(*own, F.col("id").alias("one"), after.alias("two")).where("two IS NOT NULL")
    by_start = Window.partitionBy(*own).orderBy("s", "e", "id")
    far = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("_far", far).withColumn("_new", F.coalesce((F.col("s") > F.col("_far")).cast("int"), F.lit(1)))
    grouped = begins.withColumn("_run", F.sum("_new").over(by_start)).select(*own, "_run", "id", "s", "e")
    side = lambda x: grouped.select(*own, "_run", F.col("id").alias(x), F.col("s").alias(f"{x}_s"), F.col("e").alias(f"{x}_e"))
    both = side("one").join(large(side("two")), [*own, "_run"]).where("one <> two")
    within = lambda a, b: (F.col(f"{b}_s") <= F.col(f"{a}_s")) & (F.col(f"{a}_e") <= F.col(f"{b}_e"))
    crossing = (F.col("one_s") < F.col("two_e")) & (F.col("two_s") < F.col("one_e"))
    nested = both.where(within("one", "two") | within("two", "one") | crossing).select(*own, "one", "two")
    return apart.unionByName(apart.select(*own, F.col("two").alias("one"), F.col("one").alias("two"))).unionByName(nested).distinct()


def heuristic_stats(weights: DataFrame) -> DataFrame:
    """Per child the best and the average incoming weight, and the best of its grouping."""
    own = weights.groupBy("grouping", "child").agg(F.max("attach").alias("best_attach"), F.avg("attach").alias("average"))
    return own.withColumn("best_overall", F.max("best_attach").over(Window.partitionBy("grouping")))
