"""Selections and rewrites of candidate pairs, their targets and their weights.

Pairs have grouping, pair_ix (row order), parent, child, psub, csub (subgroupings, null
for ROOT) and target (a label number). Weights add attach and label_w, an array with a
weight per label. Ties always go to the smaller pair_ix.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetree.functions.columns import ROOT, UNKNOWN, UNRELATED, best_label, name_of, number_of

KEY = ["grouping", "pair_ix"]


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of several tables of the same labels and vocabulary."""
    return reduce(lambda a, b: a.unionByName(b), others, first)


def select_pairs(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs whose (grouping, pair_ix) are wanted, weights and all."""
    return pairs.join(wanted.select(*KEY), KEY, "left_semi")


def mentioned_units(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """The units that some pair names."""
    named = pairs.select("grouping", F.explode(F.array("parent", "child")).alias("id"))
    return units.join(named, ["grouping", "id"], "left_semi")


def unknown_ids(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids that pairs name and no unit has, ROOT left out."""
    named = pairs.select(F.explode(F.array("parent", "child")).alias("id")).where(F.col("id") != ROOT).distinct()
    return named.join(units.select("id"), "id", "left_anti")


def link_units(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with both units' attributes; ROOT has the child's grouping, span (0, 0) and no subgrouping."""
    side = lambda p: units.select(
        F.col("id").alias({"p": "parent", "c": "child"}[p]), F.col("grouping").alias(f"{p}_grouping"),
        F.col("subgrouping").alias(f"{p}sub"), F.col("span_start").alias(f"{p}_start"), F.col("span_end").alias(f"{p}_end"),
    )
    out = pairs.join(side("c"), "child").join(side("p"), "parent", "left")
    root = F.col("parent") == ROOT
    zero = lambda c: F.when(root, F.lit(0)).otherwise(F.col(c)).alias(c)
    return out.where(root | F.col("p_grouping").isNotNull()).select(
        *pairs.columns, "p_grouping", "c_grouping", "psub", "csub", zero("p_start"), zero("p_end"), "c_start", "c_end"
    )


def groupings(linked: DataFrame) -> DataFrame:
    """Adds grouping, that of the member that isn't ROOT, and mismatch, whether the two differ."""
    p, c = F.col("p_grouping"), F.col("c_grouping")
    return linked.withColumns({"grouping": F.coalesce(c, p), "mismatch": F.coalesce(p != c, F.lit(False))})


def validate_corpus(units: DataFrame, pairs: DataFrame, labels: Sequence[str], strict: bool = False) -> DataFrame:
    """(rule, violations) of each sanity rule; `strict` raises if any is broken."""
    n = len(labels)
    fixed = [
        ("label_0_unknown", int(not labels or labels[0] != UNKNOWN)),
        ("label_unrelated", int(UNRELATED not in labels)),
        ("labels_empty", int(not labels)),
    ]
    count = lambda cond: F.coalesce(F.count_if(cond), F.lit(0)).cast("long")
    own = pairs.agg(
        count(F.col("target").isNull()).alias("target_missing"),
        count((F.col("target") >= n) | (F.col("target") < 0)).alias("target_range"),
    )
    rows = own.select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in own.columns],
        *[F.struct(F.lit(r).alias("rule"), F.lit(v).cast("long").alias("violations")) for r, v in fixed],
    )).alias("x")).select("x.*")
    unknown = unknown_ids(units, pairs).agg(F.count(F.lit(1)).alias("violations"))
    mismatch = groupings(link_units(units, pairs.select("parent", "child"))).agg(count(F.col("mismatch")).alias("violations"))
    out = rows.unionByName(unknown.select(F.lit("unknown_unit").alias("rule"), "violations")).unionByName(
        mismatch.select(F.lit("grouping_mismatch").alias("rule"), "violations")
    )
    if strict and (bad := out.where("violations > 0").collect()):
        raise ValueError(f"broken rules: {[tuple(r) for r in bad]}"[:1000])
    return out


def attached_only(pairs: DataFrame, unrelated: int) -> DataFrame:
    return pairs.where(F.col("target") != unrelated)


def for_attachment(pairs: DataFrame, unrelated: int) -> DataFrame:
    """The target as +1 (linked) or -1; the labels of the result are __UNK__ and UNRELATED."""
    return pairs.withColumn("target", F.when(F.col("target") == unrelated, -1).otherwise(1))


def is_root() -> Column:
    return F.col("parent") == ROOT


def is_intra() -> Column:
    """Both members in one subgrouping; a null subgrouping equals none."""
    return ~is_root() & F.coalesce(F.col("psub") == F.col("csub"), F.lit(False))


def fakeroot_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(is_root())


def intra_pairs(pairs: DataFrame, include_root: bool = False) -> DataFrame:
    """Pairs within a subgrouping; with `include_root` also all ROOT pairs."""
    return pairs.where(is_intra() | is_root() if include_root else is_intra())


def inter_pairs(pairs: DataFrame, include_root: bool = False) -> DataFrame:
    """Pairs across subgroupings; with `include_root` also all ROOT pairs."""
    inter = ~is_root() & ~is_intra()
    return pairs.where(inter | is_root() if include_root else inter)


def group_intra_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs to parse subgrouping by subgrouping: a ROOT pair goes to its child's one (`part`)."""
    return intra_pairs(pairs, include_root=True).withColumn("part", F.col("csub"))


def unit_positions(units: DataFrame, with_root: bool = True) -> DataFrame:
    """(grouping, id, pos): rank by span start. ROOT is 0 and real units start at 1, or at 0 without ROOT."""
    rank = F.row_number().over(Window.partitionBy("grouping").orderBy("span_start", "span_end", "id"))
    real = units.select("grouping", "id", (rank - (0 if with_root else 1)).cast("long").alias("pos"))
    if not with_root:
        return real
    return real.unionByName(units.select("grouping", F.lit(ROOT).alias("id"), F.lit(0).cast("long").alias("pos")).distinct())


def with_positions(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds ppos and cpos."""
    side = lambda c, p: positions.select("grouping", F.col("id").alias(c), F.col("pos").alias(p))
    rest = pairs.drop("ppos", "cpos")
    return rest.join(side("parent", "ppos"), ["grouping", "parent"]).join(side("child", "cpos"), ["grouping", "child"])


def select_window(positioned: DataFrame, width: int | None) -> DataFrame:
    """Pairs at most `width` positions apart (neighbours are 1 apart); all if None."""
    return positioned if width is None else positioned.where(F.abs(F.col("cpos") - F.col("ppos")) <= width)


def pairing_distances(positioned: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """The largest gap to the left and to the right per target (0 if none), and per `per` columns."""
    gap = F.col("cpos") - F.col("ppos")
    return positioned.groupBy(*per, "target").agg(
        F.coalesce(F.max(F.when(gap < 0, -gap)), F.lit(0)).alias("left_gap"),
        F.coalesce(F.max(F.when(gap >= 0, gap)), F.lit(0)).alias("right_gap"),
    )


def with_label_names(rows: DataFrame, labels: Sequence[str], number: str = "target", name: str = "label") -> DataFrame:
    return rows.withColumn(name, name_of(F.col(number), labels))


def with_label_numbers(rows: DataFrame, labels: Sequence[str], name: str = "label", number: str = "target") -> DataFrame:
    return rows.withColumn(number, number_of(F.col(name), labels))


def locate_in_subsets(pairs: DataFrame, *subsets: DataFrame) -> DataFrame:
    """Adds (subset, row) of each pair: its row in the last subset that has it, null if none has."""
    order = Window.partitionBy("subset", "grouping").orderBy("pair_ix")
    each = stack(*[s.select(*KEY).withColumn("subset", F.lit(i)) for i, s in enumerate(subsets)])
    each = each.withColumn("row", (F.row_number().over(order) - 1).cast("long"))
    last = each.groupBy(*KEY).agg(F.max(F.struct("subset", "row")).alias("at"))
    return pairs.join(last.select(*KEY, "at.subset", "at.row"), KEY, "left")


def relabel(weights: DataFrame, source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """label_w in the order of `target`, which must hold all of `source`; new labels weigh 0."""
    if missing := set(source) - set(target):
        raise ValueError(f"labels {sorted(missing)} are not in the target list")
    place = {x: i for i, x in enumerate(source)}
    new = F.array(*[F.get("label_w", F.lit(place[x])) if x in place else F.lit(0.0) for x in target])
    return weights.withColumn("label_w", new)


def select_in_pairs(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The predictions whose (grouping, parent, child) is a pair."""
    return predictions.join(pairs, ["grouping", "parent", "child"], "left_semi")


def to_triples(predicted: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(grouping, parent, child, label) of the predicted links."""
    out = with_label_names(predicted, labels, "prediction").where(F.col("label") != UNRELATED)
    return out.select("grouping", "parent", "child", "label")


def from_triples(pairs: DataFrame, triples: DataFrame, labels: Sequence[str], order: str | None = None) -> DataFrame:
    """Sets `prediction` of every pair, UNRELATED by default; of equal keys the last in `order` wins."""
    key = ["grouping", "parent", "child"]
    last = triples.groupBy(*key).agg((F.max_by("label", order) if order else F.max("label")).alias("_label"))
    number = F.coalesce(number_of(F.col("_label"), labels), F.lit(list(labels).index(UNRELATED)))
    return pairs.join(last, key, "left").withColumn("prediction", number).drop("_label")


def candidates(weights: DataFrame) -> DataFrame:
    """grouping, pair_ix, parent, child, attach and the best label's number."""
    return weights.select(*KEY, "parent", "child", "attach", best_label(F.col("label_w")).alias("best_label"))


def sorted_units(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(grouping, id, rank): units named by the pairs, by span; ROOT has span (0, 0) and comes first."""
    named = pairs.select("grouping", F.explode(F.array("parent", "child")).alias("id")).distinct()
    spans = named.join(units.select("grouping", "id", "span_start", "span_end"), ["grouping", "id"], "left")
    spans = spans.fillna(0, ["span_start", "span_end"])
    order = Window.partitionBy("grouping").orderBy(F.col("id") != ROOT, "span_start", "span_end", "id")
    return spans.select("grouping", "id", F.row_number().over(order).cast("long").alias("rank"))


def pair_lookup(weights: DataFrame, wanted: DataFrame) -> DataFrame:
    """The best label and weight of each wanted (grouping, parent, child); null where there is no pair."""
    known = weights.select("grouping", "parent", "child", best_label(F.col("label_w")).alias("best_label"), "attach")
    return wanted.join(known, ["grouping", "parent", "child"], "left")


def multiply_weights(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """attach and label_w times new ones by (grouping, pair_ix); what is not set yet counts as 1, prediction as __UNK__."""
    fresh = new.select(*KEY, F.col("attach").alias("_a"), F.col("label_w").alias("_l"))
    own = {c: F.col(c) if c in pairs.columns else F.lit(None) for c in ("attach", "label_w", "prediction")}
    times = F.zip_with(own["label_w"].cast("array<double>"), "_l", lambda x, y: x * y)
    return pairs.join(fresh, KEY, "left").withColumns(
        {
            "attach": F.coalesce(own["attach"].cast("double"), F.lit(1.0)) * F.col("_a"),
            "label_w": F.coalesce(times, F.col("_l")),
            "prediction": F.coalesce(own["prediction"].cast("int"), F.lit(0)),
        }
    ).drop("_a", "_l")


def deselect(weights: DataFrame, unwanted: Column, unrelated: int) -> DataFrame:
    """Unwanted pairs stay, with attach 0 and prediction UNRELATED."""
    prediction = F.col("prediction") if "prediction" in weights.columns else F.lit(0)
    return weights.withColumns(
        {
            "attach": F.when(unwanted, F.lit(0.0)).otherwise(F.col("attach")),
            "prediction": F.when(unwanted, F.lit(unrelated)).otherwise(prediction),
        }
    )


def select(weights: DataFrame, wanted: Column, unrelated: int) -> DataFrame:
    return deselect(weights, ~wanted, unrelated)


def overlay_nonfixed(weights: DataFrame, new: DataFrame, nonfixed: Column) -> DataFrame:
    """New attach and label_w for the pairs that are not fixed; the others keep theirs."""
    fresh = new.select(*KEY, F.col("attach").alias("_a"), F.col("label_w").alias("_l"))
    pick = lambda n, o: F.when(nonfixed, F.coalesce(F.col(n), F.col(o))).otherwise(F.col(o))
    return weights.join(fresh, KEY, "left").withColumns({"attach": pick("_a", "attach"), "label_w": pick("_l", "label_w")}).drop("_a", "_l")


def intra_targets(pairs: DataFrame, unrelated: int, root: int) -> DataFrame:
    """Targets for parsing within subgroupings.

    A ROOT pair whose child has no link from its own subgrouping gets the label ROOT; a
    link across subgroupings becomes UNRELATED.
    """
    linked = F.col("target") != unrelated
    headed = F.max((is_intra() & linked).cast("int")).over(Window.partitionBy("grouping", "child")) == 1
    out = pairs.withColumn("_headed", headed)
    target = (
        F.when(is_root() & ~F.col("_headed"), F.lit(root))
        .when(~is_root() & ~is_intra(), F.lit(unrelated))
        .otherwise(F.col("target"))
    )
    return out.withColumn("target", target).drop("_headed")
