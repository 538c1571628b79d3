"""Maximum spanning trees and DAGs of all documents at once, by rounds over tables.

The tree is Edmonds' branching, every step of it a join or an aggregation over the links of
all documents: each unit takes its best incoming link; where these form circles (found by
pointer doubling), every circle becomes one node, links into it weigh what they gain over
the circle's own link, and the next round sees a smaller graph. When no document has a
circle left, the levels are walked back: the link that enters a circle replaces the one
that it competes with. A document's links are never gathered; there are as many levels as
circles can be nested, at most the logarithm of the units.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetree.functions.columns import ROOT

from .storage import concluded, written

#: Name of the root within the rounds, and what a link that is no candidate counts for.
TOP, ABSENT = "", -(1 << 20)
LINK = ["parent", "child"]


def odds(attach: Column, use_prob: bool = True) -> list[Column]:
    """(high, low) of a link's score, to be added and compared part by part.

    The low part is the logit of a probability, or the raw score; certain links count 1 in
    the high part and impossible ones -1, so that sums with them lose nothing.
    """
    p = attach.cast("double")
    if not use_prob:
        return [F.lit(0).cast("long").alias("high"), p.alias("low")]
    high = F.when(p >= 1, 1).when(p <= 0, -1).otherwise(0).cast("long")
    return [high.alias("high"), F.when(high == 0, F.ln(p / (1 - p))).otherwise(0.0).alias("low")]


def with_root(links: DataFrame, units: DataFrame, key: Sequence[str], root: str = "fake") -> DataFrame:
    """Links (key, parent, child, ...) with the root named TOP; links into it, and of a unit to itself, are left out.

    `fake`: the root is ROOT, and the leftmost unit where a document has no ROOT;
    `leftmost`: always the unit with the least span, ROOT and its links being left out.
    """
    if root not in ("fake", "leftmost"):
        raise ValueError(f"unknown root {root}")
    some = links.where(F.col("parent") != F.col("child"))
    if root == "leftmost":
        some = some.where((F.col("parent") != ROOT) & (F.col("child") != ROOT))
    ends = some.select(*key, F.explode(F.array("parent", "child")).alias("id")).distinct()
    spans = units.select("grouping", "id", "span_start", "span_end")
    first = F.when(F.col("id") == ROOT, F.struct(F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("id"))).otherwise(
        F.struct(F.col("span_start").cast("long"), F.col("span_end").cast("long"), F.col("id"))
    )
    # nulls come first in structs
    tops = ends.join(spans, ["grouping", "id"], "left").groupBy(*key).agg(F.min_by("id", first).alias("_top"))
    return some.join(tops, list(key)).where("child <> _top").withColumn("parent", F.when(F.col("parent") == F.col("_top"), TOP).otherwise(F.col("parent"))).drop("_top")


def _circles(best: DataFrame, key: list[str]) -> DataFrame:
    """(key, v, ring) of the nodes on circles of their best parents u; a ring is named after its least node."""
    most = best.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    jump = best.select(*key, "v", F.col("u").alias("at"), F.col("v").alias("low"))
    steps = 1
    while steps < most:
        for _ in range(2):  # two doublings for each table written
            far = jump.select(*key, F.col("v").alias("at"), F.col("at").alias("_at"), F.col("low").alias("_low"))
            jump = jump.join(far, [*key, "at"], "left").select(
                *key, "v", F.coalesce("_at", F.lit(TOP)).alias("at"), F.least("low", F.coalesce("_low", "low")).alias("low")
            )
            steps *= 2
        jump = written(jump, "jumps")
    on = jump.where(F.col("at") != TOP).select(*key, F.col("at").alias("v")).distinct()
    return jump.join(on, [*key, "v"]).select(*key, "v", F.col("low").alias("ring"))


def _tree(links: DataFrame, key: list[str]) -> DataFrame:
    """(key, pair_ix) of the links of the best tree from TOP; links have parent, child, pair_ix, high, low."""
    each = F.struct("pair_ix", "path", "high", "low")
    better = F.struct("high", "low", -F.col("pair_ix"))
    edges = links.select(*key, F.col("parent").alias("u"), F.col("child").alias("v"), "pair_ix", F.array("child").alias("path"), "high", "low")
    nodes = edges.select(*key, F.explode(F.array("u", "v")).alias("v")).where(F.col("v") != TOP).distinct()
    absent = nodes.select(
        *key, F.lit(TOP).alias("u"), "v", F.lit(None).cast("long").alias("pair_ix"), F.array("v").alias("path"), F.lit(ABSENT).cast("long").alias("high"), F.lit(0.0).alias("low")
    )
    edges = written(edges.unionByName(absent), "edges")
    levels: list[tuple[DataFrame, DataFrame]] = []
    while True:
        best = edges.groupBy(*key, "v").agg(F.max_by(F.struct("u", each.alias("e")), better).alias("_b"))
        best = written(best.select(*key, "v", "_b.u", "_b.e"), "best")
        rings = written(_circles(best, key), "rings")
        levels.append((best, rings))
        if rings.isEmpty():
            break
        # documents without a circle are done
        own = rings.join(best.select(*key, "v", F.col("e.high").alias("_h"), F.col("e.low").alias("_l")), [*key, "v"])
        left = edges.join(rings.select(*key).distinct(), key, "left_semi")
        left = left.join(rings.select(*key, F.col("v").alias("u"), F.col("ring").alias("_from")), [*key, "u"], "left").join(own, [*key, "v"], "left")
        left = left.select(
            *key, F.coalesce("_from", "u").alias("u"), F.coalesce("ring", "v").alias("v"), "pair_ix",
            F.concat("path", F.array(F.coalesce("ring", "v"))).alias("path"),
            (F.col("high") - F.coalesce("_h", F.lit(0))).alias("high"), (F.col("low") - F.coalesce("_l", F.lit(0.0))).alias("low"),
        ).where("u <> v")
        # of links between the same nodes only the best can be taken
        one = left.groupBy(*key, "u", "v").agg(F.max_by(each, better).alias("e"))
        edges = written(one.select(*key, "u", "v", "e.*"), "edges")
    chosen = levels[-1][0].select(*key, "v", "e")
    for at in range(len(levels) - 2, -1, -1):
        best, rings = levels[at]
        down = best.join(rings, [*key, "v"], "left").withColumn("_up", F.coalesce("ring", "v"))
        up = chosen.select(*key, F.col("v").alias("_up"), F.col("e").alias("_e"))
        taken = F.col("_e").isNotNull() & (F.col("ring").isNull() | (F.element_at("_e.path", at + 1) == F.col("v")))
        chosen = down.join(up, [*key, "_up"], "left").select(*key, "v", F.when(taken, F.col("_e")).otherwise(F.col("e")).alias("e"))
    return chosen.where("e.pair_ix IS NOT NULL").select(*key, "e.pair_ix")


def spanning_tree(links: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, pair_ix) of each document's maximum spanning tree; see `with_root` and `odds` for the links.

    Units that no tree of candidates reaches have no link. Ties go to the smaller pair_ix.
    """
    return concluded(lambda: _tree(links, list(key)), "tree")


def _closed(reach: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`reach` (key, a, b; all nodes reach themselves) with the links `new` (key, i, j) added and closed again."""
    frontier = reach
    while True:
        step = frontier.join(new.select(*key, F.col("i").alias("b"), F.col("j").alias("_j")), [*key, "b"]).select(*key, "a", F.col("_j").alias("_m"))
        more = step.distinct().join(reach.select(*key, F.col("a").alias("_m"), "b"), [*key, "_m"]).select(*key, "a", "b").distinct()
        more = written(more.join(reach, [*key, "a", "b"], "left_anti"), "reach")
        if more.isEmpty():
            return reach
        reach = written(reach.unionByName(more), "reach")
        frontier = more


def _dag(links: DataFrame, tree: DataFrame, key: list[str]) -> DataFrame:
    slim = written(links.select(*key, F.col("parent").alias("i"), F.col("child").alias("j"), "pair_ix", "high", "low"), "links")
    nodes = slim.select(*key, F.explode(F.array("i", "j")).alias("a")).distinct()
    start = slim.join(tree, [*key, "pair_ix"], "left_semi").select(*key, "i", "j")
    reach = _closed(written(nodes.select(*key, "a", F.col("a").alias("b")), "reach"), written(start, "tree"), key)
    kept, open_ = [tree.select(*key, "pair_ix")], slim.join(tree, [*key, "pair_ix"], "left_anti")
    while True:
        ends = lambda x, y: reach.select(*key, F.col("a").alias(x), F.col("b").alias(y), F.lit(True).alias(f"_{x}{y}"))
        seen = open_.join(ends("i", "j"), [*key, "i", "j"], "left").join(ends("j", "i"), [*key, "i", "j"], "left")
        # a link along the order changes nothing and stays; one against it goes for good
        state = F.when(F.col("_ij"), "along").when(F.col("_ji"), "against").otherwise("open")
        seen = written(seen.select(*open_.columns, state.alias("state")), "open")
        kept.append(seen.where("state = 'along'").select(*key, "pair_ix"))
        open_ = seen.where("state = 'open'").drop("state")
        if open_.isEmpty():
            break
        # to close a circle with (i, j), a path must leave what j reaches and enter what reaches i, by links that come first
        rank = F.struct("high", "low", (-F.col("pair_ix")).alias("by"))
        out = open_.groupBy(*key, F.col("i").alias("b")).agg(F.max(rank).alias("_r"))
        into = open_.groupBy(*key, F.col("j").alias("a")).agg(F.max(rank).alias("_r"))
        leaves = reach.join(out, [*key, "b"]).groupBy(*key, F.col("a").alias("j")).agg(F.max("_r").alias("_out"))
        enters = reach.join(into, [*key, "a"]).groupBy(*key, F.col("b").alias("i")).agg(F.max("_r").alias("_in"))
        first = F.coalesce(rank > F.col("_out"), F.lit(True)) | F.coalesce(rank >= F.col("_in"), F.lit(True))
        judged = open_.join(leaves, [*key, "j"], "left").join(enters, [*key, "i"], "left").where(first)
        new = written(judged.select(*key, "i", "j", "pair_ix"), "new")
        reach = _closed(reach, new, key)
        kept.append(new.select(*key, "pair_ix"))
        open_ = open_.join(new.select(*key, "pair_ix"), [*key, "pair_ix"], "left_anti")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def spanning_dag(links: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, pair_ix) of each document's tree and of all other links that close no circle, taken by falling score.

    A round takes all links at once that none still open could forbid: a link stays if none
    that comes before it leaves what its child reaches, or enters what reaches its parent.
    The best open link of a document always is one.
    """
    own = list(key)
    return concluded(lambda: _dag(links, written(_tree(links, own), "tree"), own), "dag")


def first_of_each(links: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per parent and child of a document: that of the smallest pair_ix."""
    at = F.row_number().over(Window.partitionBy(*key, *LINK).orderBy("pair_ix"))
    return links.withColumn("_k", at).where("_k = 1").drop("_k")
