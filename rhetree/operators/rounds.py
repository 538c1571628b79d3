"""Following links by pointer doubling: each round is a join, written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import concluded, large, written


def ancestors(links: DataFrame, key: list[str], node: str, head: str) -> DataFrame:
    """(key, node, ancestor, dist) of all that a node's heads lead to; dist 1 is its own head.

    Round k joins the pairs of up to 2 ** k steps with the jumps of exactly 2 ** k, until
    no jump is left; a circle of heads is an error. There is no limit on depth or rows.
    """
    return concluded(lambda: _ancestors(links, key, node, head), "ancestors")


def _ancestors(links: DataFrame, key: list[str], node: str, head: str) -> DataFrame:
    one = links.where(F.col(node).isNotNull() & F.col(head).isNotNull()).select(*key, F.col(node).alias("node"), F.col(head).alias("ancestor"))
    jump = written(one, "jumps")
    longest = jump.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts, steps = [jump.withColumn("dist", F.lit(1).cast("long"))], 1
    while True:
        via = jump.withColumnRenamed("ancestor", "via")
        beyond = reduce(DataFrame.unionByName, parts).withColumnRenamed("node", "via")
        new = via.join(large(beyond), [*key, "via"]).select(*key, "node", "ancestor", (F.col("dist") + steps).alias("dist"))
        new = written(new, "ancestors")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, parts).withColumnRenamed("node", node)
        parts.append(new)
        steps *= 2
        jump = new.where(F.col("dist") == steps).drop("dist")
        if steps > longest and not jump.isEmpty():
            raise ValueError("heads form a circle")


def reached(starts: DataFrame, links: DataFrame, key: list[str], node: str, following: str) -> DataFrame:
    """(key, node), distinct: the starts and all that links lead to from them; a node has one link at most, none in a circle."""
    return concluded(lambda: _reached(starts, links, key, node, following), "reached")


def _reached(starts: DataFrame, links: DataFrame, key: list[str], node: str, following: str) -> DataFrame:
    jump = written(links.select(*key, F.col(node).alias("_from"), F.col(following).alias("_to")), "jumps")
    found = written(starts.select(*key, node).distinct(), "reached")
    while not jump.isEmpty():
        more = found.withColumnRenamed(node, "_from").join(large(jump), [*key, "_from"]).select(*key, F.col("_to").alias(node))
        found = written(found.unionByName(more).distinct(), "reached")
        further = jump.withColumnRenamed("_from", "_at").withColumnRenamed("_to", "_from").join(large(jump), [*key, "_from"])
        jump = written(further.select(*key, F.col("_at").alias("_from"), "_to"), "jumps")
    return found
