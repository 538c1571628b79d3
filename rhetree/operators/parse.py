"""Parsers: compositions of weighting and decoding steps, flat and in two levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetree.functions.columns import ROOT, best_label, id_number

from .pairs import group_intra_pairs, inter_pairs, intra_targets, is_intra, is_root
from .rounds import reached

Step = Callable[[DataFrame], DataFrame]
LINK = ["grouping", "parent", "child"]


class Pipeline:
    """Named steps; a step is a function of a DataFrame, or has fit(rows) and transform(rows).

    All steps are fitted on the same rows, and transform in sequence.
    """

    def __init__(self, steps: Sequence[tuple[str, object]]):
        names = [n for n, _ in steps]
        if len(set(names)) < len(names):
            raise ValueError(f"step names are not unique: {names}")
        self.steps = list(steps)

    def fit(self, rows: DataFrame) -> "Pipeline":
        return Pipeline([(n, s.fit(rows) if hasattr(s, "fit") else s) for n, s in self.steps])

    def transform(self, rows: DataFrame) -> DataFrame:
        for _, step in self.steps:
            rows = step.transform(rows) if hasattr(step, "transform") else rows.transform(step)
        return rows


def attach_times_best_label(weights: DataFrame) -> DataFrame:
    return weights.withColumn("attach", F.col("attach") * F.array_max("label_w"))


def label_unknown(predicted: DataFrame, unknown: int = 0) -> DataFrame:
    """Links whose label is undecided get their best label; the others keep theirs."""
    best = best_label(F.col("label_w"))
    return predicted.withColumn("prediction", F.when(F.col("prediction") == unknown, best).otherwise(F.col("prediction")))


def attach_pipeline(attach: object, decoder: Step) -> Pipeline:
    return Pipeline([("attach", attach), ("decode", decoder)])


def joint_pipeline(attach: object, label: object, decoder: Step) -> Pipeline:
    """Decodes attach times the best label's weight; both models must be probabilistic."""
    for model in (attach, label):
        if not getattr(model, "probabilistic", True):
            raise ValueError("the joint parser needs probabilities")
    return Pipeline([("attach", attach), ("label", label), ("multiply", attach_times_best_label), ("decode", decoder)])


def postlabel_pipeline(attach: object, label: object, decoder: Step, unrelated: int) -> Pipeline:
    """Decodes on attach alone, then labels the links."""
    def undecided(rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.when(F.col("prediction") == unrelated, unrelated).otherwise(0))

    return Pipeline([("attach", attach), ("label", label), ("decode", decoder), ("undecided", undecided), ("relabel", label_unknown)])


def intra_training_set(pairs: DataFrame, unrelated: int, root: int) -> DataFrame:
    """Pairs within subgroupings and ROOT pairs, with targets for them; `part` is the subgrouping."""
    return group_intra_pairs(intra_targets(pairs, unrelated, root))


def _headed(pairs: DataFrame, label: str, unrelated: int) -> DataFrame:
    """(grouping, child) of units that some link from their own subgrouping reaches."""
    return pairs.where(is_intra() & (F.col(label) != unrelated)).select("grouping", "child").distinct()


def inter_training_set(pairs: DataFrame, mode: str, unrelated: int) -> DataFrame:
    """What the parser across subgroupings learns from.

    global: all pairs; inter: pairs across subgroupings and ROOT pairs; head_to_head: of
    those, the ones whose members no link from their own subgrouping reaches;
    frontier_to_head: from a frontier of one subgrouping's tree to the head of another.
    """
    if mode == "global":
        return pairs
    if mode == "inter":
        return inter_pairs(pairs, include_root=True)
    if mode == "head_to_head":
        taken = _headed(pairs, "target", unrelated)
        out = inter_pairs(pairs, include_root=True).join(taken, ["grouping", "child"], "left_anti")
        return out.join(taken.withColumnRenamed("child", "parent"), ["grouping", "parent"], "left_anti")
    if mode == "frontier_to_head":
        return frontier_pairs(pairs, "target", unrelated, own_links=False)
    raise ValueError(f"unknown mode {mode}")


def frontiers(pairs: DataFrame, label: str, unrelated: int) -> DataFrame:
    """(grouping, unit, side): units on the left or right frontier of their subgrouping's tree.

    From each head (a unit that no link of its subgrouping reaches) the frontier follows
    the outermost dependent on that side, by the numbers at the end of ids.
    """
    links = pairs.where(is_intra() & (F.col(label) != unrelated)).select("grouping", "parent", "child")
    p, c = id_number(F.col("parent")), id_number(F.col("child"))
    right = links.where(p < c).groupBy("grouping", "parent").agg(F.max_by("child", id_number(F.col("child"))).alias("next"))
    left = links.where(p > c).groupBy("grouping", "parent").agg(F.min_by("child", id_number(F.col("child"))).alias("next"))
    steps = right.withColumn("side", F.lit("right")).unionByName(left.withColumn("side", F.lit("left")))
    units = pairs.select("grouping", F.col("child").alias("unit")).distinct()
    heads = units.join(_headed(pairs, label, unrelated).withColumnRenamed("child", "unit"), ["grouping", "unit"], "left_anti")
    both = heads.select("grouping", "unit", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    return reached(both, steps.withColumnRenamed("parent", "unit"), ["grouping", "side"], "unit", "next").select("grouping", "unit", "side")


def frontier_pairs(pairs: DataFrame, label: str, unrelated: int, own_links: bool = True) -> DataFrame:
    """Pairs from a frontier (or ROOT) to the head of another subgrouping on that side, and, if asked, links within a frontier."""
    front = frontiers(pairs, label, unrelated)
    heads = pairs.select("grouping", "child").distinct().join(_headed(pairs, label, unrelated), ["grouping", "child"], "left_anti")
    rising = id_number(F.col("child")) > id_number(F.col("parent"))
    on = front.select("grouping", F.col("unit").alias("parent"), "side")
    to_head = pairs.join(heads, ["grouping", "child"], "left_semi").withColumn("side", F.when(rising, "right").otherwise("left"))
    chosen = to_head.where(is_root() | ~is_intra()).join(on, ["grouping", "parent", "side"], "left_semi").drop("side").unionByName(to_head.where(is_root()).drop("side"))
    if own_links:
        own = pairs.where(is_intra() & (F.col(label) != unrelated))
        ends = front.select("grouping", F.col("unit").alias("child"), "side")
        both = own.select(*LINK).join(on, ["grouping", "parent"]).join(ends, ["grouping", "child", "side"]).select(*LINK).distinct()
        chosen = chosen.unionByName(own.join(both, LINK, "left_semi"))
    return chosen


def recombine(pairs: DataFrame, sentence: DataFrame, unrelated: int) -> DataFrame:
    """Adds sent_prediction, what the parses of the subgroupings say of a pair, null if they have nothing."""
    own = sentence.select("grouping", "pair_ix", F.col("prediction").alias("sent_prediction"))
    return pairs.join(own, ["grouping", "pair_ix"], "left")


def sentences_only(pairs: DataFrame, sentence: DataFrame, unrelated: int) -> DataFrame:
    """The predictions within subgroupings; ROOT pairs and all others are UNRELATED."""
    out = recombine(pairs, sentence, unrelated)
    kept = F.when(is_root(), F.lit(unrelated)).otherwise(F.coalesce("sent_prediction", F.lit(unrelated)))
    return out.withColumn("prediction", kept).drop("sent_prediction")


def fix_intra_links(weights: DataFrame, n_labels: int, unrelated: int) -> DataFrame:
    """A predicted link within a subgrouping (sent_prediction) weighs 1, and so does its label alone."""
    fixed = is_intra() & F.coalesce(F.col("sent_prediction") != unrelated, F.lit(False))
    hot = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: (i == F.col("sent_prediction")).cast("double"))
    return weights.withColumns(
        {"attach": F.when(fixed, 1.0).otherwise(F.col("attach")), "label_w": F.when(fixed, hot).otherwise(F.col("label_w"))}
    )


def head_to_head(weights: DataFrame, sentence: DataFrame, decoder: Step, unrelated: int) -> DataFrame:
    """Decodes the pairs between heads (children of predicted ROOT pairs) and ROOT; other pairs keep the sentence's prediction."""
    placed = recombine(weights, sentence, unrelated)
    heads = placed.where(is_root() & (F.col("sent_prediction") != unrelated)).select("grouping", F.col("child").alias("unit"))
    child = heads.withColumnRenamed("unit", "child")
    parent = heads.withColumnRenamed("unit", "parent").unionByName(heads.select("grouping", F.lit(ROOT).alias("parent")).distinct())
    between = placed.join(child, ["grouping", "child"], "left_semi").join(parent, ["grouping", "parent"], "left_semi")
    return _merge(placed, decoder(between.drop("sent_prediction")), unrelated)


def _merge(placed: DataFrame, decoded: DataFrame, unrelated: int) -> DataFrame:
    doc = decoded.select("grouping", "pair_ix", F.col("prediction").alias("_doc"))
    own = F.when(is_root(), F.lit(None)).otherwise(F.col("sent_prediction"))
    out = placed.join(doc, ["grouping", "pair_ix"], "left")
    return out.withColumn("prediction", F.coalesce("_doc", own, F.lit(unrelated))).drop("_doc", "sent_prediction")


def frontier_to_head(weights: DataFrame, sentence: DataFrame, decoder: Step, n_labels: int, unrelated: int) -> DataFrame:
    """As head_to_head, but from frontiers, with the sentence links on them fixed."""
    placed = fix_intra_links(recombine(weights, sentence, unrelated), n_labels, unrelated)
    judged = placed.withColumn("_s", F.coalesce("sent_prediction", F.lit(unrelated)))
    chosen = frontier_pairs(judged, "_s", unrelated).drop("_s")
    return _merge(placed, decoder(chosen.drop("sent_prediction")), unrelated)


def soft(weights: DataFrame, sentence: DataFrame, decoder: Step, n_labels: int, unrelated: int) -> DataFrame:
    """Decodes all pairs, with the sentence links fixed."""
    placed = fix_intra_links(recombine(weights, sentence, unrelated), n_labels, unrelated)
    return decoder(placed.drop("sent_prediction"))


def two_level_fit(fit: Callable[[DataFrame], Step], pairs: DataFrame, mode: str, unrelated: int, root: int) -> tuple[Step, Step]:
    """Two parsers, for within and across subgroupings, each from its training set."""
    return fit(intra_training_set(pairs, unrelated, root)), fit(inter_training_set(pairs, mode, unrelated))


def two_level_transform(weights: DataFrame, decode_part: Step, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Parses each subgrouping (rows have `part`, to decode by grouping and part), then combines."""
    sentence = decode_part(group_intra_pairs(weights))
    return combine(weights, sentence)


def lost_and_hallucinated(predicted: DataFrame, unrelated: int) -> DataFrame:
    """(grouping, kind, level, n): gold links not predicted (lost), predicted ones not gold (hallucinated), within and across subgroupings."""
    level = F.when(is_intra(), "intra").otherwise("inter")
    gold, pred = F.col("target") != unrelated, F.col("prediction") != unrelated
    kind = F.when(gold & ~pred, "lost").when(pred & ~gold, "hallucinated")
    rows = predicted.where(~is_root()).select("grouping", kind.alias("kind"), level.alias("level")).where("kind IS NOT NULL")
    return rows.groupBy("grouping", "kind", "level").agg(F.count(F.lit(1)).alias("n"))


def zip_nbest(sentence: DataFrame) -> DataFrame:
    """(grouping, k, links): the k-th best predictions of all subgroupings together; rows have part, k, parent, child, label."""
    link = F.struct("part", "parent", "child", "label")
    parts = sentence.select("grouping", "part").distinct().groupBy("grouping").agg(F.count(F.lit(1)).alias("_all"))
    out = sentence.groupBy("grouping", "k").agg(F.sort_array(F.collect_list(link)).alias("links"), F.count_distinct("part").alias("_n"))
    return out.join(parts, "grouping").where("_n = _all").drop("_n", "_all")
