"""Attachment in reading order with a right frontier: all documents' search states in one table.

Units are numbered in reading order, the first of them the start. Round j attaches unit j
of every document: each state is joined with the candidates from the units that it still
can reach. States of a document that can reach the same units have the same future, so
only the best of them stay, which makes the search exact; `beam` keeps the best states of
a document however they differ. Documents share the rounds, and a state is a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import concluded, large, written

HEURISTICS, FRONTIERS = ("zero", "max", "best", "average"), ("none", "simple", "full")


def _futures(links: DataFrame, key: list[str], heuristic: str) -> DataFrame:
    """(key, c, future): what the heuristic expects the units after c to cost at least (`average` may expect too much)."""
    each = links.groupBy(*key, "c").agg(F.min("cost").alias("best"), F.avg("cost").alias("average"))
    ahead = {
        "zero": F.lit(0.0), "max": F.min("best").over(Window.partitionBy(*key)), "best": F.col("best"), "average": F.col("average"),
    }[heuristic]
    later = Window.partitionBy(*key).orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_h", ahead)
    return each.select(*key, "c", F.coalesce(F.sum("_h").over(later), F.lit(0.0)).alias("future"))


def _best_parents(links: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """With all earlier units in reach, every unit takes its best one; a document with a unit that has none is left without links."""
    best = links.groupBy(*key, "c").agg(F.min_by("pair_ix", F.struct("bad", "cost", "pair_ix")).alias("pair_ix"))
    whole = best.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")).join(sizes, key).where("_m = n - 1").select(*key)
    return best.join(whole, key, "left_semi").select(*key, F.lit(1).alias("k"), "pair_ix")


def _search(links: DataFrame, sizes: DataFrame, key: list[str], heuristic: str, frontier: str, beam: int | None, nbest: int) -> DataFrame:
    most = sizes.agg(F.max("n")).first()[0] or 0
    order = [F.col("bad"), F.col("spent"), F.col("path")]
    states = sizes.select(*key, F.array(F.lit(0)).alias("open"), F.lit(0).cast("long").alias("bad"), F.lit(0.0).alias("spent"), F.array().cast("array<long>").alias("path"))
    ended = []
    futures = bound = None
    if beam is None and nbest == 1 and frontier != "none":
        # a unit can always hang from the one before it: no state that must cost more than that chain is of use
        futures = _futures(links, key, heuristic)
        chain = links.where("p = c - 1").groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), F.max("bad").alias("_bad"), F.sum("cost").alias("_most"))
        bound = chain.join(sizes, key).where("_m = n - 1 AND _bad = 0").select(*key, "_most")
        futures = written(futures.join(large(bound), key), "futures")
    for c in range(1, most):
        here = links.where(F.col("c") == c).drop("c").withColumnRenamed("bad", "_bad")
        # a document whose last unit is placed is done
        ended.append(states.join(large(sizes.where(F.col("n") == c).select(*key)), key, "left_semi"))
        if frontier == "none":
            grown = states.join(large(here), key)
            reach: Column = F.col("open")
        else:
            grown = states.select("*", F.posexplode("open").alias("_at", "p")).join(large(here), [*key, "p"])
            keep = F.when(F.col("coordinating"), F.col("_at")).otherwise(F.col("_at") + 1) if frontier == "full" else F.col("_at") + 1
            reach = F.concat(F.slice("open", F.lit(1), keep), F.array(F.lit(c)))
        grown = grown.select(
            *key, reach.alias("open"), (F.col("bad") + F.col("_bad")).alias("bad"), (F.col("spent") + F.col("cost")).alias("spent"), F.concat("path", F.array("pair_ix")).alias("path")
        )
        if futures is not None:
            now = futures.where(F.col("c") == c).drop("c")
            fits = F.col("_most").isNull() | ((F.col("bad") == 0) & (F.col("spent") + F.col("future") <= F.col("_most") + 1e-9 * (1 + F.abs("_most"))))
            grown = grown.join(large(now), key, "left").where(fits).drop("future", "_most")
        alike = F.row_number().over(Window.partitionBy(*key, "open").orderBy(*order))
        grown = grown.withColumn("_k", alike).where(F.col("_k") <= nbest).drop("_k")
        if beam is not None:
            grown = grown.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= max(beam, nbest)).drop("_k")
        states = written(grown, "states")
    ended.append(states.join(large(sizes.where(F.col("n") == most).select(*key)), key, "left_semi"))
    final = reduce(DataFrame.unionByName, ended).where(F.size("path") > 0)
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return final.withColumn("k", k).where(F.col("k") <= nbest).select(*key, "k", F.explode("path").alias("pair_ix"))


def reading_order_trees(
    links: DataFrame, key: Sequence[str], heuristic: str = "best", frontier: str = "none", beam: int | None = None, nbest: int = 1,
) -> DataFrame:
    """(key, k, pair_ix): the links of the k-th best way (from 1) to attach all units in reading order.

    Links have key, p and c (numbers in reading order from 0), pair_ix, high and low part of
    the score, and for the full frontier the boolean `coordinating`. A way costs the sum
    of its links' negated scores. `frontier`: none keeps all earlier units in reach; simple
    drops those below the point of attachment; full also the point itself under a
    coordinating label. Of equal ways the one whose pair_ix come first wins. `heuristic`
    bounds what is still to come and cuts off states that cannot win (`average` may cut
    the best one; the others don't); it does nothing under a beam, as all states of a
    round have the same units to come. Without a beam the states of a frontier can grow
    exponentially with a document's units; with one they are at most `beam`. A document
    that cannot be attached whole has no links.
    """
    if heuristic not in HEURISTICS or frontier not in FRONTIERS:
        raise ValueError(f"unknown heuristic {heuristic} or frontier {frontier}")
    own = list(key)

    def run() -> DataFrame:
        sizes = written(links.groupBy(*own).agg((F.max(F.greatest("p", "c")) + 1).cast("int").alias("n")), "sizes")
        coordinating = F.coalesce(F.col("coordinating"), F.lit(False)) if "coordinating" in links.columns else F.lit(False)
        slim = links.where("p < c").select(
            *own, F.col("p").cast("int").alias("p"), F.col("c").cast("int").alias("c"), "pair_ix", (-F.col("high")).alias("bad"), (-F.col("low")).alias("cost"), coordinating.alias("coordinating")
        )
        slim = written(slim, "numbered")
        if frontier == "none" and nbest == 1:
            return _best_parents(slim, sizes, own)
        return _search(slim, sizes, own, heuristic, frontier, beam, nbest)

    return concluded(run, "reading-order")
