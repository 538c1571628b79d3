"""Best projective trees of all documents at once: a dynamic programme over a chart table.

Units are numbered in reading order, the root first. A span (i, j) of a document has the
scores of four structures over it: its head is the left or the right end, and it is open
(its ends have just been linked) or closed. One round finds the spans of one width, for all
documents. A row holds the structures of all spans from i up to (i, j), and of all spans
down to it that end at j: a span that is wider by one meets two neighbouring rows, pairs
their entries at the place where they meet, and keeps the best split. So a round moves a row
per span of its width, whatever the number of splits. Then the splits are followed from the
whole document down, some levels at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import concluded, deleted, large, new_table, written

#: What a link that is no candidate adds to the high part of a score.
ABSENT = -(1 << 20)
#: Levels of splits that are followed for each table written.
LEVELS = 4
#: Rounds whose tables stand at once; then their splits are put with the others.
KEPT = 8
#: Closed structures, right (head i) or left (head j): where they are split, and where the open one in them is.
SPLITS = ("rc_k", "rc_s", "lc_k", "lc_s")


def _entry(names: Sequence[str], of: dict[str, Column], **more: Column) -> Column:
    """Scores of structures as one entry of a row's lists."""
    parts = [of[s][p].alias(f"{s}_{p}") for s in names for p in "hl"]
    return F.struct(*parts, *[c.alias(n) for n, c in more.items()])


def _from(of: dict[str, Column], j: Column) -> Column:
    return _entry(("rc", "lc", "ro"), of, k=j.cast("int"), s=of["ro"]["k"])


def _upto(of: dict[str, Column]) -> Column:
    return _entry(("lc", "lo", "rc"), of, s=of["lo"]["k"])


def _chart(links: DataFrame, sizes: DataFrame, key: list[str], one_root: bool) -> DataFrame:
    """(key, i, j, and SPLITS) of all spans of two units and more, after the rounds."""
    spark = links.sparkSession
    most = sizes.agg(F.max("n")).first()[0] or 0
    path = new_table(spark, "splits")
    single = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("l"), F.lit(0).alias("k"))
    alone = dict.fromkeys(("ro", "lo", "rc", "lc"), single)
    state = sizes.select(*key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(
        *key, "i", F.col("i").alias("j"), F.array(_from(alone, F.col("i"))).alias("a"), F.array(_upto(alone)).alias("b"), *[F.lit(0).alias(s) for s in SPLITS]
    )
    score, right = F.struct(F.col("high").alias("h"), F.col("low").alias("l")), F.col("p") < F.col("c")
    arcs = links.groupBy(*key, F.least("p", "c").alias("i"), F.abs(F.col("c") - F.col("p")).alias("width"))
    arcs = written(arcs.agg(F.max(F.when(right, score)).alias("_r"), F.max(F.when(~right, score)).alias("_l")).sortWithinPartitions("width"), "arcs")
    standing, fresh = [], [state]
    for width in range(1, most):
        ahead, after = state.select(*key, "i", "a"), state.select(*key, (F.col("i") - 1).alias("i"), "b")
        arc = arcs.where(F.col("width") == width).drop("width")
        met = ahead.join(large(after), [*key, "i"]).join(large(arc), [*key, "i"], "left").withColumn("j", F.col("i") + width)
        sums = lambda x, y, s, t: ((x[f"{s}_h"] + y[f"{t}_h"]).alias("h"), (x[f"{s}_l"] + y[f"{t}_l"]).alias("l"), (-x["k"]).alias("k"))
        beside = lambda x, y: F.struct(*sums(x, y, "rc", "lc"))
        # compared: the score, then the first split; s only comes along
        inner = [F.slice("a", 2, width - 1), F.slice("b", 1, width - 1)]
        best = met.withColumns({
            "open": F.array_max(F.zip_with("a", "b", beside)),
            "in_l": F.array_max(F.zip_with(*inner, lambda x, y: F.struct(*sums(x, y, "lc", "lo"), y["s"].alias("s")))),
            "in_r": F.array_max(F.zip_with(*inner, lambda x, y: F.struct(*sums(x, y, "ro", "rc"), x["s"].alias("s")))),
        })
        # the root's only child hangs from a span that holds nothing else of the root's
        best = best.withColumn("open_r", F.when(F.col("i") > 0, F.col("open")).otherwise(beside(F.get("a", F.lit(0)), F.get("b", F.lit(0)))) if one_root else F.col("open"))
        linked = lambda x, arc: F.struct(
            (F.col(f"{x}.h") + F.coalesce(f"{arc}.h", F.lit(ABSENT))).alias("h"), (F.col(f"{x}.l") + F.coalesce(f"{arc}.l", F.lit(0.0))).alias("l"), (-F.col(f"{x}.k")).alias("k")
        )
        to_root = F.struct((F.col("open.h") + ABSENT).alias("h"), F.col("open.l").alias("l"), (-F.col("open.k")).alias("k"))
        best = best.withColumns({"ro": linked("open_r", "_r"), "lo": F.when(F.col("i") > 0, linked("open", "_l")).otherwise(to_root)})
        # closed: the open span itself, its own end as the split, or an inner split; the first wins ties
        own = lambda x, k: F.struct(F.col(f"{x}.h").alias("h"), F.col(f"{x}.l").alias("l"), (-F.col(k)).alias("k"), F.col(f"{x}.k").alias("s"))
        best = best.withColumns({"lc": F.greatest(own("lo", "i"), "in_l"), "rc": F.greatest(own("ro", "j"), "in_r")})
        now = {s: F.col(s) for s in ("ro", "lo", "rc", "lc")}
        splits = [(-F.col(f"{s}.k")).alias(f"{s}_k") if p == "k" else F.col(f"{s}.s").alias(f"{s}_s") for s, p in (name.split("_") for name in SPLITS)]
        state = best.select(
            *key, "i", "j", F.concat("a", F.array(_from(now, F.col("j")))).alias("a"), F.concat(F.array(_upto(now)), "b").alias("b"), *splits
        )
        place = new_table(spark, "chart")
        state.write.parquet(place)
        state = spark.read.schema(state.schema).parquet(place)
        standing, fresh = [*standing, place], [*fresh, state]
        if len(standing) > KEPT:
            _keep(fresh, key, path)
            deleted(spark, standing[:-1])
            standing, fresh = standing[-1:], []
    _keep(fresh or [state.where("false")], key, path)
    return spark.read.schema(state.select(*key, "i", "j", *SPLITS).schema).parquet(path)


def _keep(rounds: list[DataFrame], key: list[str], path: str) -> None:
    """Puts the splits of some rounds with those of the others."""
    slim = [r.select(*key, "i", "j", *SPLITS).where("i < j") for r in rounds]
    reduce(DataFrame.unionByName, slim).write.mode("append").parquet(path)


def _links(split: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """(key, p, c) of the links of the best structures: the splits followed down from the whole document.

    A row is a closed structure over (i, j), to be followed, or a link (p, c), with no i.
    """
    i, j, right, k, s = (F.col(x) for x in ("i", "j", "right", "_k", "_s"))
    no = F.lit(None).cast("int")
    closed = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), right.alias("right"), no.alias("p"), no.alias("c"))
    link = lambda p, c: F.struct(no.alias("i"), no.alias("j"), F.lit(True).alias("right"), p.alias("p"), c.alias("c"))
    yes, false = F.lit(True), F.lit(False)

    def below(at: DataFrame) -> DataFrame:
        here = at.join(large(split), [*key, "i", "j"], "left")
        here = here.withColumns({"_k": F.when(right, F.col("rc_k")).otherwise(F.col("lc_k")), "_s": F.when(right, F.col("rc_s")).otherwise(F.col("lc_s"))})
        parts = F.when(i.isNull(), F.array(link(F.col("p"), F.col("c")))).when(
            right, F.array(link(i, k), closed(i, s, yes), closed(s + 1, k, false), closed(k, j, yes))
        ).otherwise(F.array(link(j, k), closed(i, k, false), closed(k, s, yes), closed(s + 1, j, false)))
        return here.select(*key, F.explode(parts).alias("_x")).select(*key, "_x.*").where("p IS NOT NULL OR i < j")

    whole = closed(F.lit(0), (F.col("n") - 1).cast("int"), yes)
    at, found = sizes.where("n > 1").select(*key, whole.alias("_x")).select(*key, "_x.*"), []
    while not found or not at.isEmpty():
        for _ in range(LEVELS):
            at = below(at)
        table = written(at, "followed")
        found.append(table.where("p IS NOT NULL").select(*key, "p", "c"))
        at = table.where("p IS NULL")
    return reduce(DataFrame.unionByName, found)


def projective_tree(links: DataFrame, key: Sequence[str], one_root: bool = True) -> DataFrame:
    """(key, pair_ix) of each document's best projective tree from its first unit.

    Links have key, p and c (numbers in reading order from 0), pair_ix and the score's high
    and low part. `one_root`: the first unit has a single child. Of equal splits the first
    wins; links that are no candidates are left out of the tree found.
    """
    own = list(key)

    def run() -> DataFrame:
        slim = written(links.select(*own, F.col("p").cast("int").alias("p"), F.col("c").cast("int").alias("c"), "pair_ix", "high", "low"), "numbered")
        sizes = written(slim.groupBy(*own).agg((F.max(F.greatest("p", "c")) + 1).alias("n")), "sizes")
        chart = _chart(slim, sizes, own, one_root)
        return large(_links(chart, sizes, own)).join(slim, [*own, "p", "c"]).select(*own, "pair_ix")

    return concluded(run, "projective")
