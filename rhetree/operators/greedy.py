"""Greedy attachment of neighbours, a round for all documents at once.

Every round takes each document's best link from a unit that is left to one of its
neighbours; the link's source goes, and its neighbours become the target's too. A unit that
has gone can still be a target. The neighbours are rows, passed on by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import concluded, large, written


def _greedy(links: DataFrame, near: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    near = written(near.select(*key, "p", "c").distinct(), "near")
    links = written(links.where("attach > 0 AND p <> c").select(*key, "p", "c", "pair_ix", "attach"), "links")
    # units that have gone, and the links taken
    gone, rounds = None, 0
    while True:
        # the last unit left has nothing to hang from
        live = links.join(large(near), [*key, "p", "c"]).join(large(sizes.where(F.col("n") > rounds + 1)), key, "left_semi")
        if gone is not None:
            live = live.join(large(gone.select(*key, "p")), [*key, "p"], "left_anti")
        best = live.groupBy(*key).agg(F.max_by(F.struct("p", "c", "pair_ix"), F.struct("attach", -F.col("p"), -F.col("c"))).alias("_b"))
        new = written(best.select(*key, "_b.*"), "taken")
        if new.isEmpty():
            break
        # a unit may become its own neighbour and be passed on as such
        passed = new.select(*key, "p", F.col("c").alias("_to")).join(large(near), [*key, "p"]).select(*key, F.col("_to").alias("p"), "c")
        near = written(near.unionByName(passed).distinct(), "near")
        rounds += 1
        gone = new if gone is None else written(gone.unionByName(new), "gone")
    return gone.select(*key, "pair_ix") if gone is not None else new.select(*key, "pair_ix")


def greedy_links(links: DataFrame, near: DataFrame, sizes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, pair_ix) of the links taken; links have key, p, c (numbers in reading order), pair_ix and attach, near has key, p, c,
    sizes the number n of a document's units.

    A link must weigh more than 0; of equal ones that of the first source goes first, then
    that to the first target. As in a one-at-a-time search, the last unit left is no source:
    with one unit left there is nothing to attach.
    """
    own = list(key)
    return concluded(lambda: _greedy(links, near, sizes, own), "greedy")
