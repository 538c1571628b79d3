"""Counts and metrics of predicted links against gold ones.

`gold` are pairs with target (label number); `predictions` are (grouping, parent, child,
prediction). `per` names columns that both sides carry beside grouping, such as config
and fold: counts are kept apart by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhetree.functions.columns import ROOT, ratio

LINK = ["grouping", "parent", "child"]


def _count(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0)).cast("long")


def _links(rows: DataFrame, label: str, unrelated: int, per: Sequence[str], undirected: bool) -> DataFrame:
    own, per = rows.where(F.col(label) != unrelated), [c for c in per if c not in LINK]
    if not undirected:
        return own.groupBy(*per, *LINK).agg(F.max(label).alias("label"))
    ends = [F.least("parent", "child").alias("parent"), F.greatest("parent", "child").alias("child")]
    return own.select(*per, "grouping", *ends, F.lit(0).alias("label")).distinct()


def edge_counts(gold: DataFrame, predictions: DataFrame, unrelated: int, per: Sequence[str] = (), undirected: bool = False) -> DataFrame:
    """tpos_attach, tpos_label, tpos_fpos (predicted) and tpos_fneg (gold) links.

    A prediction of __UNK__ is a link; repeats count once. Undirected links have no label hits.
    """
    key = [*(c for c in per if c not in LINK), *LINK]
    left = _links(gold, "target", unrelated, per, undirected).withColumnRenamed("label", "g")
    right = _links(predictions, "prediction", unrelated, per, undirected).withColumnRenamed("label", "p")
    both = left.join(right, key, "full")
    hit = F.col("g").isNotNull() & F.col("p").isNotNull()
    return both.groupBy(*per).agg(
        _count(hit).alias("tpos_attach"),
        _count(F.lit(False) if undirected else hit & (F.col("g") == F.col("p"))).alias("tpos_label"),
        _count(F.col("p").isNotNull()).alias("tpos_fpos"),
        _count(F.col("g").isNotNull()).alias("tpos_fneg"),
    )


def edge_counts_by_label(gold: DataFrame, predictions: DataFrame, n_labels: int, unrelated: int, per: Sequence[str] = ()) -> DataFrame:
    """For each label number but UNRELATED: hits, predicted and gold rows; zeros for labels without rows."""
    spark = gold.sparkSession
    labels = spark.createDataFrame([(i,) for i in range(n_labels) if i != unrelated], "label int")
    g = _links(gold, "target", unrelated, per, False).withColumnRenamed("label", "g")
    p = _links(predictions, "prediction", unrelated, per, False).withColumnRenamed("label", "p")
    both = g.join(p, [*(c for c in per if c not in LINK), *LINK], "full")
    sides = both.select(*per, F.explode(F.array(
        F.struct(F.col("g").cast("int").alias("label"), F.lit(1).alias("gold"), F.lit(0).alias("pred"), F.coalesce((F.col("g") == F.col("p")).cast("int"), F.lit(0)).alias("hit")),
        F.struct(F.col("p").cast("int").alias("label"), F.lit(0).alias("gold"), F.lit(1).alias("pred"), F.lit(0).alias("hit")),
    )).alias("x")).select(*per, "x.*").where("label IS NOT NULL")
    sums = sides.groupBy(*per, "label").agg(*[F.sum(c).alias(c) for c in ("hit", "pred", "gold")])
    every = labels if not per else gold.select(*per).distinct().crossJoin(F.broadcast(labels))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n)
    return every.join(sums, [*per, "label"], "left").select(
        *per, "label", zero("hit", "tpos"), zero("pred", "tpos_fpos"), zero("gold", "tpos_fneg")
    )


def unit_counts(gold: DataFrame, predictions: DataFrame, unrelated: int, per: Sequence[str] = ()) -> DataFrame:
    """Units whose sorted parents (and labels) are those of the gold graph.

    Units are all that the gold pairs name, ROOT once per grouping.
    """
    def heads(rows: DataFrame, label: str, x: str) -> DataFrame:
        own = rows.where(F.col(label) != unrelated).select(*per, "grouping", F.col("child").alias("unit"), "parent", F.col(label).cast("int").alias("l")).distinct()
        return own.groupBy(*per, "grouping", "unit").agg(
            F.sort_array(F.collect_set("parent")).alias(f"{x}_parents"),
            F.sort_array(F.collect_set(F.struct("parent", "l"))).alias(f"{x}_links"),
        )

    units = gold.select(*per, "grouping", F.explode(F.array("parent", "child")).alias("unit")).distinct()
    key = [*per, "grouping", "unit"]
    both = units.join(heads(gold, "target", "g"), key, "left").join(heads(predictions, "prediction", "p"), key, "left")
    return both.groupBy(*per).agg(
        _count(F.col("g_parents").eqNullSafe(F.col("p_parents"))).alias("tpos_attach"),
        _count(F.col("g_links").eqNullSafe(F.col("p_links"))).alias("tpos_label"),
        F.count(F.lit(1)).alias("total"),
    )


def confusion_matrix(gold: DataFrame, predictions: DataFrame, n_labels: int) -> DataFrame:
    """(true, pred, n) over all labels, zeros included; only pairs with a prediction count."""
    spark = gold.sparkSession
    ix = spark.range(n_labels)
    every = ix.select(F.col("id").cast("int").alias("true")).crossJoin(ix.select(F.col("id").cast("int").alias("pred")))
    seen = gold.join(predictions.select(*LINK, "prediction"), LINK)
    seen = seen.groupBy(F.col("target").cast("int").alias("true"), F.col("prediction").cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(seen, ["true", "pred"], "left").fillna(0, ["n"])


def sum_counts(counts: DataFrame, by: Sequence[str], per: str) -> DataFrame:
    """Counts summed over `by` and `per`, and over `by` alone (`per` null): one grouping-sets aggregate."""
    columns = [c for c in counts.columns if c not in (*by, per)]
    sums = [F.sum(c).alias(c) for c in columns]
    return counts.groupingSets([[F.col(c) for c in [*by, per]], [F.col(c) for c in by]], *by, per).agg(*sums)


def heads_of(rows: DataFrame, label: str, unrelated: int) -> DataFrame:
    """(grouping, child, parent, label): the first link of each child."""
    own = rows.where(F.col(label) != unrelated)
    first = F.min(F.struct("pair_ix", "parent", F.col(label).cast("int").alias("l"))).alias("x")
    return own.groupBy("grouping", "child").agg(first).select("grouping", "child", F.col("x.parent").alias("parent"), F.col("x.l").alias("label"))


def uas_las_ls(gold_heads: DataFrame, pred_heads: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Shares of units with the right head, head and label, label. ROOT is no child, so it never counts."""
    pred = pred_heads.select("grouping", "child", F.col("parent").alias("_p"), F.col("label").alias("_l"))
    both = gold_heads.join(pred, ["grouping", "child"], "left")
    head, label = F.col("parent").eqNullSafe(F.col("_p")), F.col("label").eqNullSafe(F.col("_l"))
    share = lambda c: F.avg(c.cast("double"))
    return both.groupBy(*per).agg(share(head).alias("uas"), share(head & label).alias("las"), share(label).alias("ls"))


def tree_loss(gold: DataFrame, predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    """1 - shared rows / gold rows per grouping; rows are equal in all of `key`; 0 without gold rows."""
    g = gold.select("grouping", *key).distinct()
    p = predicted.select("grouping", *key).distinct()
    n = g.groupBy("grouping").agg(F.count(F.lit(1)).alias("n"))
    hits = g.join(p, ["grouping", *key], "left_semi").groupBy("grouping").agg(F.count(F.lit(1)).alias("hits"))
    every = g.select("grouping").unionByName(p.select("grouping")).distinct()
    out = every.join(n, "grouping", "left").join(hits, "grouping", "left").fillna(0, ["n", "hits"])
    loss = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(1 - ratio(F.col("hits"), F.col("n")))
    return out.select("grouping", loss.alias("loss"))


def labelled_tree_loss(gold_heads: DataFrame, pred_heads: DataFrame) -> DataFrame:
    """Per grouping: a child counts half for the right parent, full if the label is right too."""
    pred = pred_heads.select("grouping", "child", F.col("parent").alias("_p"), F.col("label").alias("_l"))
    both = gold_heads.join(pred, ["grouping", "child"], "left")
    head = F.coalesce(F.col("parent") == F.col("_p"), F.lit(False))
    credit = F.when(head & (F.col("label") == F.col("_l")), 1.0).when(head, 0.5).otherwise(0.0)
    return both.groupBy("grouping").agg((1 - F.avg(credit)).alias("loss"))


def structured_prf(gold: DataFrame, predicted: DataFrame, key: Sequence[str], label: str = "label", average: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label, or of all (`micro`), over structures of all groupings.

    Hits are counted on sets of (grouping, key, label), predicted and gold rows as given;
    a quotient with denominator 0 is 0.
    """
    if average not in (None, "micro"):
        raise NotImplementedError(f"average {average}")
    full = ["grouping", *key, label]
    hits = gold.select(*full).distinct().join(predicted.select(*full).distinct(), full, "left_semi")
    each = [
        rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        for kind, rows in (("tp", hits), ("pred", predicted), ("true", gold))
    ]
    counts = each[0].unionByName(each[1]).unionByName(each[2])
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    sums = counts.groupBy(*([] if average else [label])).agg(total("tp"), total("pred"), total("true"))
    p, r = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("true"))
    out = sums.withColumns({"precision": p, "recall": r})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).withColumn("support", F.col("true")).drop("tp", "pred", "true")


#: Span metrics: spans alone, with nuclearity, with relation, with both.
SPAN_METRICS = ("S", "S+N", "S+R", "S+N+R")


def span_labels(spans: DataFrame, metric: str, drop_leaves: bool = True) -> DataFrame:
    """Spans with the label that a metric looks at; for S, spans of one unit may be dropped."""
    label = {
        "S": F.lit("1"), "S+N": F.col("nuclearity"), "S+R": F.col("relation"),
        "S+N+R": F.concat_ws("-", "relation", "nuclearity"),
    }[metric]
    own = spans.where("span_lo < span_hi") if metric == "S" and drop_leaves else spans
    return own.select("grouping", "span_lo", "span_hi", label.alias("label"))


def span_prf(gold: DataFrame, predicted: DataFrame, metric: str = "S", average: str | None = "micro") -> DataFrame:
    return structured_prf(span_labels(gold, metric), span_labels(predicted, metric), ["span_lo", "span_hi"], average=average)


def span_prf_detailed(gold: DataFrame, predicted: DataFrame, metric: str = "S+N+R") -> DataFrame:
    """Per label, largest support first, and a line `avg` of the averages weighted by support."""
    each = span_prf(gold, predicted, metric, None)
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    line = each.agg(*[weighted(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return each.unionByName(line.withColumn("label", F.lit("avg"))).orderBy(F.col("label") == "avg", F.desc("support"), "label")


def span_counts(gold: DataFrame, predicted: DataFrame, per: Sequence[str] = ("grouping",)) -> DataFrame:
    """tpos, tpos_fpos and tpos_fneg spans of each metric."""
    out = None
    for metric in SPAN_METRICS:
        g, p = (span_labels(x, metric).distinct() for x in (gold, predicted))
        full = ["grouping", "span_lo", "span_hi", "label"]
        both = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), full, "full")
        part = both.groupBy(*per).agg(
            _count(F.expr("g = 1 AND p = 1")).alias("tpos"), _count(F.col("p").isNotNull()).alias("tpos_fpos"),
            _count(F.col("g").isNotNull()).alias("tpos_fneg"),
        ).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out


def tree_spans(nodes: DataFrame) -> DataFrame:
    """All spans but the root's, from nodes with their depth."""
    return nodes.where("depth > 0")


def span_loss(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Tree loss on labelled spans, 0 without a gold span."""
    return tree_loss(gold, predicted, ["span_lo", "span_hi", "nuclearity", "relation"])


def last_attach_accuracy(instances: DataFrame) -> DataFrame:
    """How often the candidate right before a unit is its parent: over units with a positive candidate, and with exactly one.

    Instances have grouping and the map feats with m#target, D#LAST and c#class.
    """
    yes = lambda k: F.col("feats")[k] == "True"
    units = instances.groupBy("grouping", F.col("feats")["m#target"].alias("unit")).agg(
        F.count_if(yes("c#class")).alias("n"), F.max((yes("D#LAST") & yes("c#class")).cast("int")).alias("right")
    )
    return units.where("n > 0").agg(
        F.avg(F.col("right").cast("double")).alias("accuracy"),
        F.avg(F.when(F.col("n") == 1, F.col("right").cast("double"))).alias("accuracy_single"),
    )


def accuracy_by_feature(chosen: DataFrame) -> DataFrame:
    """(feature, value, n, accuracy) of the chosen candidates, and one row of all (feature null)."""
    right = (F.col("feats")["c#class"] == "True").cast("double")
    each = chosen.select(F.explode(F.map_filter("feats", lambda k, v: ~k.startswith("c#") & ~k.startswith("m#"))).alias("feature", "value"), right.alias("right"))
    agg = [F.count(F.lit(1)).alias("n"), F.avg("right").alias("accuracy")]
    every = chosen.select(right.alias("right")).agg(*agg).select(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value"), "n", "accuracy")
    return each.groupBy("feature", "value").agg(*agg).unionByName(every)


def feature_counts(instances: DataFrame) -> DataFrame:
    """Occurrences of each feature, the most frequent first."""
    names = instances.select(F.explode(F.map_keys("feats")).alias("feature"))
    return names.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "feature")


def odds_ratios(instances: DataFrame) -> DataFrame:
    """Per (feature, value): its count in class 1 over that in class 0; one more over 1 if class 0 has none."""
    yes = F.col("feats")["c#class"] == "True"
    each = instances.select(F.explode(F.map_filter("feats", lambda k, v: ~k.startswith("c#"))).alias("feature", "value"), yes.alias("yes"))
    sums = each.groupBy("feature", "value").agg(F.count_if("yes").alias("n1"), F.count_if(~F.col("yes")).alias("n0"))
    odds = F.when(F.col("n0") == 0, (F.col("n1") + 1).cast("double")).otherwise(ratio(F.col("n1"), F.col("n0")))
    return sums.withColumn("odds", odds)
