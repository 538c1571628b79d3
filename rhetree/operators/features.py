"""Feature maps: instances are rows with a map `feats` from names to values as text.

Names begin with their kind: C# continuous, D# discrete, m# meta, c# class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import concluded, written

#: Classes of relation names by scheme.
SCHEMES = {
    "subord_coord": {
        "subord": ("elaboration", "e-elab", "attribution", "comment", "flashback", "explanation", "alternation"),
        "coord": (
            "continuation", "parallel", "contrast", "temploc", "frame", "narration", "conditional", "result", "goal",
            "background",
        ),
        "NONE": ("null", "unknown", "NONE"),
    },
    "pdtb": {
        "contingency": ("explanation", "conditional", "result", "goal", "background"),
        "temporal": ("temploc", "narration", "flashback"),
        "comparison": ("parallel", "contrast"),
        "expansion": ("frame", "elaboration", "e-elab", "attribution", "continuation", "comment", "alternation"),
        "error": ("null", "unknown", "NONE"),
    },
    "minsdrt": {
        "structural": ("parallel", "contrast", "alternation", "conditional"),
        "sequence": ("result", "narration", "continuation"),
        "expansion": ("frame", "elaboration", "e-elab", "attribution", "comment", "explanation"),
        "temporal": ("temploc", "goal", "flashback", "background"),
        "error": ("null", "unknown", "NONE"),
    },
}
#: The `minsdrt` classes whose relations are coordinating; all others are subordinating.
COORDINATING = ("structural", "sequence")


def collapse_labels(rows: DataFrame, scheme: str, label: str = "label", to: str = "kind") -> DataFrame:
    """Adds the class of a label in a scheme; a label without one stays as it is."""
    items = [F.lit(x) for kind, names in SCHEMES[scheme].items() for n in names for x in (n, kind)]
    return rows.withColumn(to, F.coalesce(F.create_map(*items)[F.col(label)], F.col(label)))


def is_kind(name: Column, *kinds: str) -> Column:
    return F.substring(name, 1, 2).isin(*[f"{k}#" for k in kinds])


#: Values of all binarised features up to which they are sent along as one map.
MOST_VALUES = 10_000


def binarise(instances: DataFrame) -> DataFrame:
    """Discrete features of more than two values, or with a value but True and False, as one boolean per value.

    `name=value` is True for the instance's own value and False for the others the
    feature has; an instance without the feature gets none of them. A few values go along
    as a map; with more than MOST_VALUES the instances' items are joined with them by feature.
    """
    items = instances.select(F.explode("feats").alias("k", "v")).where(is_kind(F.col("k"), "D"))
    each = items.groupBy("k", "v").agg(F.lit(1).alias("one"))
    many = each.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("v").isin("True", "False")).alias("odd")).where("n > 2 OR odd > 0")
    if (many.agg(F.sum("n")).first()[0] or 0) > MOST_VALUES:
        return concluded(lambda: _binarised(instances, each, many), "binarised")
    kinds = each.join(many, "k").groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("values"))
    # one row, of MOST_VALUES values at most
    table = kinds.agg(F.map_from_entries(F.collect_list(F.struct("k", "values"))).alias("_kinds"))
    both = instances.crossJoin(F.broadcast(table))
    fresh = F.flatten(F.transform(F.map_entries("feats"), lambda e: F.when(
        F.map_contains_key("_kinds", e["key"]),
        F.transform(F.col("_kinds")[e["key"]], lambda v: F.struct(
            F.concat(e["key"], F.lit("="), v).alias("key"), F.when(v == e["value"], "True").otherwise("False").alias("value")
        )),
    ).otherwise(F.array(e))))
    return both.withColumn("feats", F.map_from_entries(fresh)).drop("_kinds")


def _binarised(instances: DataFrame, each: DataFrame, many: DataFrame) -> DataFrame:
    rows = written(instances.withColumn("_id", F.monotonically_increasing_id()), "instances")
    items = rows.select("_id", F.explode("feats").alias("k", "v"))
    values = each.select("k", F.col("v").alias("_value")).join(many.select("k"), "k")
    fresh = items.join(values, "k").select("_id", F.concat("k", F.lit("="), "_value").alias("k"), F.when(F.col("_value") == F.col("v"), "True").otherwise("False").alias("v"))
    rest = items.join(many.select("k"), "k", "left_anti").select("_id", "k", "v")
    feats = fresh.unionByName(rest).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_feats"))
    out = rows.join(feats, "_id", "left").withColumn("feats", F.coalesce("_feats", F.when(F.col("feats").isNotNull(), F.col("feats"))))
    return out.select(*instances.columns)


def discretize(instances: DataFrame, feature: str, bins: Sequence[float]) -> DataFrame:
    """The value becomes the first letter of the name and the smallest edge that is not below it (the last if none)."""
    edges = F.array(*[F.lit(float(x)) for x in sorted(bins)])
    value = F.col("feats")[feature].try_cast("double")
    edge = F.coalesce(F.get(F.filter(edges, lambda e: value <= e), F.lit(0)), F.element_at(edges, -1))
    name = F.regexp_extract(F.lit(feature), r"^(?:.#)?(.)", 1)
    coded = F.concat(name, F.regexp_replace(edge.cast("string"), r"\.0$", ""))
    new = F.map_concat(F.map_filter("feats", lambda k, v: k != feature), F.create_map(F.lit(feature), coded))
    return instances.withColumn("feats", F.when(value.isNotNull(), new).otherwise(F.col("feats")))


def filter_features(instances: DataFrame, names: Sequence[str], keep: bool = True, continuous: bool = True) -> DataFrame:
    """Keeps (or loses) the named features; class and meta features always stay, continuous ones if asked."""
    listed = lambda k: k.isin(*names) if names else F.lit(False)
    stays = lambda k: listed(k) if keep else ~listed(k)
    fixed = lambda k: is_kind(k, "c", "m") | (is_kind(k, "C") if continuous else F.lit(False))
    return instances.withColumn("feats", F.map_filter("feats", lambda k, v: fixed(k) | stays(k)))


def filter_instances(instances: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Instances that have all of the given values."""
    for k, v in conditions.items():
        instances = instances.where(F.col("feats")[k] == v)
    return instances


def index_instances(instances: DataFrame, key: Sequence[str], order: str, positive: str = "c#class") -> DataFrame:
    """One instance per key: of a run of equal keys the last that isn't False, or the first; of runs the last."""
    keyed = instances.withColumn("_key", F.xxhash64(*key))
    # runs lie between changes of the key within a grouping, which is the unit of order
    w = Window.partitionBy("grouping").orderBy(order)
    change = F.coalesce((F.lag("_key").over(w) != F.col("_key")).cast("int"), F.lit(1))
    keyed = keyed.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    yes = F.coalesce(F.col("feats")[positive] != "False", F.lit(False))
    runs = keyed.groupBy("grouping", *[k for k in key if k != "grouping"], "_run").agg(
        F.coalesce(F.max(F.when(yes, F.col(order))), F.min(order)).alias(order)
    )
    last = runs.groupBy("grouping", *[k for k in key if k != "grouping"]).agg(F.max_by(order, "_run").alias(order))
    return instances.join(last.select("grouping", order), ["grouping", order], "left_semi")


def propagate_heads(instances: DataFrame, heads: DataFrame, drop_orphans: bool = False, tail: bool = False) -> DataFrame:
    """Instances on complex units take the features of the instance of their heads.

    `heads` maps (grouping, id) of a complex unit to the simple unit at its head. The
    head's features are copied, True if either class is, instances of a unit with itself
    go, and so do the instances that were copied from. An instance without a head
    instance stays unless `drop_orphans`. With `tail` nothing is replaced: the head
    instance's features are added under their names and `_TAIL`.
    """
    names = heads.select("grouping", F.col("id").alias("_id"), F.col("head").alias("_head"))
    side = lambda k, x: names.select("grouping", F.col("_id").alias(k), F.col("_head").alias(x))
    own = instances.join(side("source", "_hs"), ["grouping", "source"], "left").join(side("target", "_ht"), ["grouping", "target"], "left")
    own = own.withColumn("_complex", F.col("_hs").isNotNull() | F.col("_ht").isNotNull())
    own = own.withColumns({"_hs": F.coalesce("_hs", "source"), "_ht": F.coalesce("_ht", "target")})
    base = instances.select("grouping", F.col("source").alias("_hs"), F.col("target").alias("_ht"), F.col("feats").alias("_feats"))
    both = own.join(base, ["grouping", "_hs", "_ht"], "left").where("NOT _complex OR _hs <> _ht")
    found = F.col("_complex") & F.col("_feats").isNotNull()
    if tail:
        renamed = F.transform_keys(F.map_filter("_feats", lambda k, v: ~is_kind(k, "c", "m")), lambda k, v: F.concat(k, F.lit("_TAIL")))
        return both.withColumn("feats", F.when(found, F.map_concat("feats", renamed)).otherwise(F.col("feats"))).select(*instances.columns)
    rest = lambda m: F.map_filter(m, lambda k, v: ~is_kind(k, "c", "m"))
    meta = F.map_filter("feats", lambda k, v: is_kind(k, "m"))
    yes = (F.col("feats")["c#class"] == "True") | (F.col("_feats")["c#class"] == "True")
    new = F.map_concat(meta, rest("_feats"), F.create_map(F.lit("c#class"), F.when(yes, "True").otherwise("False")))
    out = both.withColumn("feats", F.when(found, new).otherwise(F.col("feats")))
    if drop_orphans:
        out = out.where(~F.col("_complex") | F.col("_feats").isNotNull())
    used = own.where("_complex").select("grouping", F.col("_hs").alias("source"), F.col("_ht").alias("target"))
    copied = out.where("NOT _complex").join(used, ["grouping", "source", "target"], "left_anti")
    return copied.unionByName(out.where("_complex")).select(*instances.columns)


def duplicate_features(instances: DataFrame, split: str) -> DataFrame:
    """Each boolean feature f becomes f and f_split: the one that `split` points to has the value, the other is False."""
    on = F.coalesce(F.col("feats")[split] == "True", F.lit(False))
    boolean = lambda k, v: v.isin("True", "False") & ~is_kind(k, "c", "m") & (k != split)
    first = F.transform_values("feats", lambda k, v: F.when(boolean(k, v) & on, "False").otherwise(v))
    second = F.transform_values(F.map_filter("feats", boolean), lambda k, v: F.when(on, v).otherwise("False"))
    return instances.withColumn("feats", F.map_concat(first, F.transform_keys(second, lambda k, v: F.concat(k, F.lit("_split")))))


def cross_features(instances: DataFrame, crossing: Sequence[str]) -> DataFrame:
    """Adds `f2-f1=v1` with the value of f2 for every crossing feature f1 and open feature f2."""
    open_ = F.map_filter("feats", lambda k, v: is_kind(k, "C", "D"))
    new = F.col("feats")
    for f1 in crossing:
        own = F.map_filter(open_, lambda k, v: k != f1)
        crossed = F.transform_keys(own, lambda k, v: F.concat(k, F.lit(f"-{f1}="), F.col("feats")[f1]))
        new = F.when(F.col("feats")[f1].isNotNull(), F.map_concat(new, crossed)).otherwise(new)
    return instances.withColumn("feats", new)


def _escape(x: Column) -> Column:
    return F.regexp_replace(x, ":", "*")


def _formatted(feats: Column) -> Column:
    """name:value of continuous features, name=value:1.0 of the others, sorted; class and meta features left out."""
    items = F.filter(F.map_entries(feats), lambda e: ~is_kind(e["key"], "m", "c"))
    one = lambda e: F.when(is_kind(e["key"], "C"), F.concat(_escape(e["key"]), F.lit(":"), e["value"])).otherwise(
        F.concat(_escape(e["key"]), F.lit("="), _escape(e["value"]), F.lit(":1.0"))
    )
    return F.array_join(F.sort_array(F.transform(items, one)), " ")


def class_instances(instances: DataFrame) -> DataFrame:
    """Adds class (1 or 0) and `line`, the class with the formatted features."""
    number = (F.coalesce(F.col("feats")["c#class"], F.lit("False")) == "True").cast("int")
    out = instances.withColumn("class", number)
    return out.withColumn("line", F.concat_ws(" ", F.col("class").cast("string"), _formatted(F.col("feats"))))


def rank_instances(instances: DataFrame, unit: str = "m#target") -> DataFrame:
    """(grouping, unit, n, lines): the sorted candidates of each unit; units without a right one are left out."""
    lines = class_instances(instances)
    out = lines.groupBy("grouping", F.col("feats")[unit].alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), F.max("class").alias("_some"), F.sort_array(F.collect_list("line"), asc=False).alias("lines")
    )
    return out.where("_some = 1").drop("_some")


def dense_rows(instances: DataFrame, names: Sequence[str], key: Sequence[str]) -> DataFrame:
    """A column per feature: a missing one is False, a missing continuous one `?`."""
    absent = lambda n: F.lit("?" if n.startswith("C#") else "False")
    return instances.select(*key, *[F.coalesce(F.col("feats")[n], absent(n)).alias(n) for n in names])


def feature_lines(instances: DataFrame, form: str = "sparse") -> DataFrame:
    """Text lines: `sparse` all items, `basket` without False ones, `sanity` only (source, target, class) of positives."""
    if form == "sanity":
        own = instances.where(F.col("feats")["c#class"] == "True")
        return own.select(F.concat_ws(",", *[F.col("feats")[k] for k in ("m#source", "m#target", "c#class")]).alias("value"))
    feats = F.map_filter("feats", lambda k, v: v != "False") if form == "basket" else F.col("feats")
    item = F.transform(F.map_entries(feats), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return instances.select(F.array_join(F.sort_array(item), " ").alias("value"))
