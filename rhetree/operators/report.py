"""Reports over counts, and statistics that compare configurations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetree.functions.columns import ratio

from . import score as M
from .pairs import is_intra, is_root
from .storage import concluded, written


def with_prf(counts: DataFrame, tpos: str = "tpos", prefix: str = "", correction: float | None = None) -> DataFrame:
    """Adds precision, recall and f1 (0 where a denominator is 0); `correction` also a corrected recall and f1."""
    p, r = f"{prefix}precision", f"{prefix}recall"
    f = lambda r: ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    out = counts.withColumns({p: ratio(F.col(tpos), F.col("tpos_fpos")), r: ratio(F.col(tpos), F.col("tpos_fneg"))})
    out = out.withColumn(f"{prefix}f1", f(r))
    if correction is None:
        return out
    if not 0 <= correction <= 1:
        raise ValueError("the correction must be between 0 and 1")
    out = out.withColumn(f"{r}_corrected", F.col(r) * correction)
    return out.withColumn(f"{prefix}f1_corrected", f(f"{r}_corrected"))


def edge_report(gold: DataFrame, predictions: DataFrame, unrelated: int, per: Sequence[str] = ("config",)) -> DataFrame:
    """undirected_, directed_ and label_ precision, recall, f1 of each configuration over all folds."""
    und = with_prf(M.edge_counts(gold, predictions, unrelated, per, True), "tpos_attach", "undirected_")
    und = und.drop("tpos_attach", "tpos_label", "tpos_fpos", "tpos_fneg")
    one = M.edge_counts(gold, predictions, unrelated, per)
    both = with_prf(with_prf(one, "tpos_attach", "directed_"), "tpos_label", "label_")
    return both.join(und, list(per)) if per else both.crossJoin(und)


def span_report(gold: DataFrame, predicted: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    counts = M.span_counts(gold, predicted, list(per) or ["grouping"])
    sums = counts.groupBy(*per, "metric").agg(*[F.sum(c).alias(c) for c in ("tpos", "tpos_fpos", "tpos_fneg")])
    return with_prf(sums)


def label_report(gold: DataFrame, predictions: DataFrame, n_labels: int, unrelated: int, per: Sequence[str] = ()) -> DataFrame:
    """Per label: gold rows and precision, recall, f1, the most frequent label first."""
    out = with_prf(M.edge_counts_by_label(gold, predictions, n_labels, unrelated, per))
    return out.orderBy(*per, F.desc("tpos_fneg"), "label")


def unit_report(gold: DataFrame, predictions: DataFrame, unrelated: int, per: Sequence[str] = ()) -> DataFrame:
    c = M.unit_counts(gold, predictions, unrelated, per)
    return c.select(*per, "total", ratio(F.col("tpos_attach"), F.col("total")).alias("attach_accuracy"), ratio(F.col("tpos_label"), F.col("total")).alias("label_accuracy"))


def combined_report(parts: dict[str, DataFrame], key: str = "config") -> DataFrame:
    """A row per configuration with the columns of all parts, named after the part, sorted."""
    out = None
    for name, part in parts.items():
        own = part.select(key, *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c != key])
        out = own if out is None else out.join(own, key, "full")
    return out.orderBy(key)


def slices() -> dict[str, Column]:
    return {"whole": F.lit(True), "intra": is_intra(), "inter": ~is_root() & ~is_intra(), "root": is_root()}


def full_report(pairs: DataFrame, predictions: DataFrame, folds: DataFrame, unrelated: int) -> DataFrame:
    """Link counts and scores of each configuration, over all folds, on each slice of the pairs.

    `predictions` have config and fold. A prediction counts if its grouping is in the test
    part of its fold. One plan: both sides get the array of their pair's slices.
    """
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in slices().items()]), lambda x: x.isNotNull())
    sliced = pairs.withColumn("slice", F.explode(named))
    tested = predictions.join(folds, ["grouping", "fold"])
    configs = predictions.select("config").distinct()
    gold = sliced.join(folds, "grouping").crossJoin(F.broadcast(configs))
    pred = tested.join(sliced.select("grouping", "parent", "child", "slice"), ["grouping", "parent", "child"])
    counts = M.edge_counts(gold, pred, unrelated, ["config", "slice"])
    return with_prf(with_prf(counts, "tpos_attach", "attach_"), "tpos_label", "label_")


def standard_error(scores: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean and the standard error of the mean (n - 1 in the deviation)."""
    n = F.count(value)
    sem = F.when(n > 1, F.stddev_samp(value) / F.sqrt(n))
    return scores.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), sem.alias("sem"))


def t_quantile(p: float, n: int) -> float:
    """The p-quantile of Student's t with n degrees of freedom, by bisection on its distribution."""
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_distribution(mid, n) < p else (low, mid)
    return (low + high) / 2


def t_distribution(t: float, n: int) -> float:
    """P(T <= t) of Student's t: 1 - I(n / (n + t^2); n/2, 1/2) / 2 for t >= 0."""
    tail = incomplete_beta(n / (n + t * t), n / 2, 0.5) / 2
    return 1 - tail if t >= 0 else tail


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + k * d) or tiny)
        c = (1 + k / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def confidence_interval(scores: DataFrame, value: str, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high): the mean plus and minus the t quantile times its standard error."""
    row = standard_error(scores, value).first()
    if row["n"] < 2:
        raise ValueError("an interval needs two points")
    half = t_quantile((1 + level) / 2, row["n"] - 1) * row["sem"]
    return row["mean"], row["mean"] - half, row["mean"] + half


#: Ranges that values are dealt into before they are ranked.
RANGES = 64


def ranked_values(rows: DataFrame, by: Sequence[str], value: str, **counts: Column) -> DataFrame:
    """A row per distinct value of each group: n rows, `counts` (aggregates over them), and rank, which ties share as their average.

    Values are counted first, so that ties are one row. Counts of value ranges (at
    approximate quantiles of all rows) give each range its first rank, and only within a
    range are values put in order: no group is sorted as a whole. Null values are left out.
    """
    own = list(by)
    each = rows.where(F.col(value).isNotNull()).groupBy(*own, value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = each.agg(F.percentile_approx(value, steps, 10 * RANGES)).first()[0] or []
    over = [(F.col(value) >= c).cast("int") for c in sorted(set(cuts))]
    each = each.withColumn("_range", reduce(Column.__add__, over, F.lit(0)))
    total = each.groupBy(*own, "_range").agg(F.sum("n").alias("_n"))
    # RANGES rows a group at most
    before = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*own, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*own, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("_ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(total, [*own, "_range"])
    return placed.withColumn("rank", F.col("_first") + F.col("_ahead") + (F.col("n") + 1) / 2).drop("_range", "_first", "_ahead")


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of the normal distribution (Abramowitz and Stegun 7.1.26, error under 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values of the approximation
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def wilcoxon(pairs: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Paired signed ranks: n, statistic (the smaller rank sum), z and p by the normal approximation.

    Zero differences are dropped; ties share ranks and lower the variance.
    """
    d = pairs.withColumn("_d", F.round(F.col(x) - F.col(y), 12)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    ranked = ranked_values(d, by, "_a", ups=F.count_if(F.col("_d") > 0))
    sums = ranked.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("ups")), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.col("rank") * (F.col("n") - F.col("ups"))), F.lit(0.0)).alias("down"),
        F.sum(F.col("n").cast("double") * (F.col("n").cast("double") * F.col("n") - 1)).alias("_ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    out = sums.withColumn("statistic", F.least("up", "down"))
    out = out.withColumn("z", F.when(spread > 0, (F.col("statistic") - n * (n + 1) / 4) / spread).otherwise(0.0))
    return out.withColumn("p", _two_sided(F.col("z"))).select(*by, "n", "statistic", "z", "p")


def paired_t(pairs: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """n and the paired t statistic (null where the differences do not vary)."""
    d = pairs.withColumn("_d", F.col(x) - F.col(y))
    n, sd = F.count("_d"), F.stddev_samp("_d")
    return d.groupBy(*by).agg(n.alias("n"), F.when(sd > 0, F.avg("_d") / (sd / F.sqrt(n))).alias("t"))


def t_p_value(t: float, n: int) -> float:
    """Two-sided p of a t statistic over n differences."""
    return 2 * (1 - t_distribution(abs(t), n - 1))


def mann_whitney(rows: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """Independent rank sums: u of the first group, z and p by the normal approximation."""
    ranked = ranked_values(rows, [], value, own=F.count_if(F.col(group) == first))
    sums = ranked.agg(
        F.sum("own").alias("n1"), F.sum(F.col("n") - F.col("own")).alias("n2"), F.sum(F.col("rank") * F.col("own")).alias("r"),
        F.sum(F.col("n").cast("double") * (F.col("n").cast("double") * F.col("n") - 1)).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = sums.withColumn("u", F.col("r") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    out = out.withColumn("z", (F.col("u") - n1 * n2 / 2) / spread)
    return out.withColumn("p", _two_sided(F.col("z"))).select("n1", "n2", "u", "z", "p")


#: Bits of a hash that each step of the refinement looks at, and rows of a permutation that are then put in order.
REFINED_BITS, ORDERED = 12, 4096


def permutation_test(rows: DataFrame, value: str, group: str, first: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """The share of n permutations of the joined series whose first part sums to less than the first series.

    A permutation's first part are the rows of the least hashes of its number and the row's
    place. All permutations' rows are counted and summed up by the first bits of their
    hashes; what lies below the bin that holds the last row of the first part is settled,
    and only that bin's rows are looked at again, by their next bits, until few are left
    to be put in order. Null values count as nothing.
    """
    return concluded(lambda: _permutation_test(rows, value, group, first, n, seed), "permutations")


def permutation_hash(seed: int) -> Column:
    """The hash of a permutation `perm` and a row's place `i`, without a sign."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "perm", "i"), 4)


def _permutation_test(rows: DataFrame, value: str, group: str, first: str, n: int, seed: int) -> DataFrame:
    series = rows.select(F.col(value).alias("v"), F.coalesce(F.col(group) == first, F.lit(False)).alias("own"))
    placed = written(series.withColumn("i", F.monotonically_increasing_id()), "series")
    size = placed.agg(F.count_if("own").alias("n1"), F.coalesce(F.sum(F.when(F.col("own"), F.col("v"))), F.lit(0)).alias("observed")).first()
    every = placed.select("v", "i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("perm")).withColumn("h", permutation_hash(seed))
    total = F.coalesce(F.sum("v"), F.lit(0))
    # a row per permutation: rows still to be taken, the sum so far, and the bin to be looked into
    state = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("perm"), F.lit(size["n1"]).cast("long").alias("want"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("bin"))
    bits, rest = 60, every.withColumn("bin", F.lit(0).cast("long"))
    while True:
        bits = max(0, bits - REFINED_BITS)
        fine = rest.drop("bin").withColumn("bin", F.shiftrightunsigned("h", bits))
        bins = fine.groupBy("perm", "bin").agg(F.count(F.lit(1)).alias("rows"), total.cast("double").alias("part"))
        ahead = Window.partitionBy("perm").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumns({"before": F.coalesce(F.sum("rows").over(ahead), F.lit(0)), "below": F.coalesce(F.sum("part").over(ahead), F.lit(0.0))})
        # the bin in which the last wanted row lies; all wanted: past the last bin
        at = bins.join(state.select("perm", "want", "sum"), "perm").where("before < want").groupBy("perm").agg(F.max_by(F.struct("*"), "bin").alias("x")).select("x.*")
        step = at.select("perm", (F.col("want") - F.col("before")).alias("want"), (F.col("sum") + F.col("below")).alias("sum"), "bin", "rows", "part")
        step = step.withColumn("whole", F.col("want") >= F.col("rows"))
        step = written(step.select("perm", F.when(F.col("whole"), 0).otherwise(F.col("want")).alias("want"), (F.col("sum") + F.when(F.col("whole"), F.col("part")).otherwise(0.0)).alias("sum"), "bin", "rows"), "bins")
        open_ = step.where("want > 0")
        rest = every.withColumn("bin", F.shiftrightunsigned("h", bits)).join(F.broadcast(open_.select("perm", "bin")), ["perm", "bin"], "left_semi")
        done = state.join(step.select("perm"), "perm", "left_anti").select("perm", "want", "sum", "bin").unionByName(step.drop("rows"))
        state = written(done, "state")
        most = open_.agg(F.max("rows")).first()[0] or 0
        if most <= ORDERED or bits == 0:
            break
    order = Window.partitionBy("perm").orderBy("h", "i")
    last = rest.join(state.select("perm", "want"), "perm").withColumn("k", F.row_number().over(order)).where("k <= want")
    last = last.groupBy("perm").agg(total.cast("double").alias("more"))
    sums = state.join(last, "perm", "left").select("perm", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("s"))
    return sums.agg(F.avg((F.col("s") < F.lit(float(size["observed"]))).cast("double")).alias("share"))


def effect_size(rows: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """Difference of the means over the pooled standard deviation."""
    own = F.col(group) == first
    a, b = F.when(own, F.col(value)), F.when(~own, F.col(value))
    out = rows.agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
        F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"),
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    out = out.withColumn("_sd", pooled)
    return out.select(F.when(F.col("_sd") > 0, (F.col("m1") - F.col("m2")) / F.col("_sd")).alias("effect"))


def significance_matrix(scores: DataFrame, unit: str = "fold", value: str = "score", level: float = 0.01) -> DataFrame:
    """Wilcoxon of every two configurations over shared units, those with p under `level`."""
    side = lambda x: scores.select(unit, F.col("config").alias(x), F.col(value).alias(f"v_{x}"))
    both = side("a").join(side("b"), unit).where("a < b")
    return wilcoxon(both, "v_a", "v_b", ["a", "b"]).where(F.col("p") < level)


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """(n, fingerprint): equal for equal rows in any order."""
    each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned(each, 24)).alias("low"), F.bit_xor(each).alias("high")).select(
        "n", F.concat_ws("-", F.hex("high"), F.hex("low")).alias("fingerprint")
    )


def score_json(report: DataFrame, scores: DataFrame | None = None, key: str = "config", value: str = "score", level: float = 0.95) -> DataFrame:
    """(key, json) of a report's rows; with `scores` also n, mean, standard error and interval half-width from two points on."""
    rest = [c for c in report.columns if c != key]
    fields = [F.struct(*rest).alias("scores")]
    if scores is not None:
        spread = standard_error(scores, value, [key])
        # one quantile for each number of points, worked out on the driver
        sizes = [r["n"] for r in spread.select("n").distinct().collect() if r["n"] > 1]
        items = [x for n in sizes for x in (F.lit(n).cast("long"), F.lit(t_quantile((1 + level) / 2, n - 1)))]
        width = F.create_map(*items)[F.col("n")] * F.col("sem") if items else F.lit(None).cast("double")
        report = report.join(spread.withColumn("half_width", width), key, "left")
        fields.append(F.struct("n", "mean", "sem", "half_width").alias("spread"))
    return report.select(key, F.to_json(F.struct(*fields)).alias("json"))
