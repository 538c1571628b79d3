"""Queries of counts, metrics, reports, statistics and graph comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from rhetree.operators import decode as D
from rhetree.operators import folds as C
from rhetree.operators import graph as G
from rhetree.operators import report as R
from rhetree.operators import score as M
from rhetree.operators import pairs as P

from .bridge import BEST, LABELS, ROOT_IX, UNRELATED_IX
from .pair_queries import FOLDS, INTER, INTRA, NAME
from .registry import query

BEST_PARENT = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY grouping, child ORDER BY attach DESC, pair_ix) = 1 THEN {BEST} ELSE 4 END AS prediction FROM weights"""
OVER_HALF = f"SELECT *, CASE WHEN attach > 0.5 THEN {BEST} ELSE 4 END AS prediction FROM weights"
BOTH = f"SELECT 'best' AS config, * FROM ({BEST_PARENT}) UNION ALL SELECT 'half' AS config, * FROM ({OVER_HALF})"
COUNTS = """count(*) FILTER (WHERE target <> 4 AND prediction <> 4) AS tpos_attach,
    count(*) FILTER (WHERE target <> 4 AND prediction = target) AS tpos_label,
    count(*) FILTER (WHERE prediction <> 4) AS tpos_fpos, count(*) FILTER (WHERE target <> 4) AS tpos_fneg"""


def prf_sql(tpos: str, prefix: str = "") -> str:
    p, r = f"{tpos} / CAST(tpos_fpos AS DOUBLE)", f"{tpos} / CAST(tpos_fneg AS DOUBLE)"
    p = f"CASE WHEN tpos_fpos = 0 THEN 0 ELSE {p} END"
    r = f"CASE WHEN tpos_fneg = 0 THEN 0 ELSE {r} END"
    f = f"CASE WHEN tpos_fpos + tpos_fneg = 0 THEN 0 ELSE 2 * {tpos} / CAST(tpos_fpos + tpos_fneg AS DOUBLE) END"
    return f"round({p}, 9) AS {prefix}precision, round({r}, 9) AS {prefix}recall, round({f}, 9) AS {prefix}f1"


def rounded(df, digits=9):
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def best(b):
    return D.decode_best_incoming(b.weights, UNRELATED_IX)


def both_configs(b):
    half = D.decode_threshold(b.weights, UNRELATED_IX)
    columns = ["grouping", "pair_ix", "parent", "child", "psub", "csub", "ppos", "cpos", "target", "prediction"]
    each = [df.select(F.lit(n).alias("config"), *columns) for n, df in (("best", best(b)), ("half", half))]
    return each[0].unionByName(each[1])


def heads(b, label, rows=None):
    return M.heads_of(best(b) if rows is None else rows, label, UNRELATED_IX)


GOLD_HEADS = "SELECT grouping, child, parent, target AS label FROM pairs WHERE target <> 4"
PRED_HEADS = f"SELECT grouping, child, parent, prediction AS label FROM ({BEST_PARENT}) WHERE prediction <> 4"


@query(f"SELECT config, {COUNTS} FROM ({BOTH}) GROUP BY 1")
def m1_edge_counts(b):
    rows = both_configs(b)
    return M.edge_counts(rows, rows, UNRELATED_IX, ["config"])


@query(f"""SELECT count(*) FILTER (WHERE g AND p) AS tpos_attach, 0::BIGINT AS tpos_label, count(*) FILTER (WHERE p) AS tpos_fpos, count(*) FILTER (WHERE g) AS tpos_fneg
           FROM (SELECT grouping, least(parent, child) AS a, greatest(parent, child) AS b, bool_or(target <> 4) AS g, bool_or(prediction <> 4) AS p
                 FROM ({BEST_PARENT}) GROUP BY 1, 2, 3)""")
def m2_edge_counts_undirected(b):
    rows = best(b)
    return M.edge_counts(rows, rows, UNRELATED_IX, undirected=True)


BY_LABEL = f"""SELECT l.label, count(*) FILTER (WHERE target = l.label AND prediction = l.label) AS tpos, count(*) FILTER (WHERE prediction = l.label) AS tpos_fpos,
    count(*) FILTER (WHERE target = l.label) AS tpos_fneg FROM (SELECT unnest([0, 1, 2, 3, 5]) AS label) l, ({BEST_PARENT}) w GROUP BY 1"""


@query(BY_LABEL)
def m3_edge_counts_by_label(b):
    rows = best(b)
    return M.edge_counts_by_label(rows, rows, len(LABELS), UNRELATED_IX)


UNIT_COUNTS = f"""SELECT count(*) FILTER (WHERE gp IS NOT DISTINCT FROM pp) AS tpos_attach, count(*) FILTER (WHERE gl IS NOT DISTINCT FROM pl) AS tpos_label, count(*) AS total
    FROM (SELECT grouping, unit FROM (SELECT grouping, parent AS unit FROM pairs UNION SELECT grouping, child FROM pairs)) u
    LEFT JOIN (SELECT grouping, child AS unit, string_agg(parent, ',' ORDER BY parent) AS gp, string_agg(concat(parent, ':', target), ',' ORDER BY parent) AS gl
               FROM pairs WHERE target <> 4 GROUP BY 1, 2) g USING (grouping, unit)
    LEFT JOIN (SELECT grouping, child AS unit, string_agg(parent, ',' ORDER BY parent) AS pp, string_agg(concat(parent, ':', prediction), ',' ORDER BY parent) AS pl
               FROM ({BEST_PARENT}) WHERE prediction <> 4 GROUP BY 1, 2) p USING (grouping, unit)"""


@query(UNIT_COUNTS)
def m4_unit_counts(b):
    rows = best(b)
    return M.unit_counts(rows, rows, UNRELATED_IX)


@query(f"""SELECT t.x::INTEGER AS true, p.x::INTEGER AS pred, count(w.pair_ix) AS n FROM (SELECT unnest(range(6)) AS x) t CROSS JOIN (SELECT unnest(range(6)) AS x) p
           LEFT JOIN ({BEST_PARENT}) w ON w.target = t.x AND w.prediction = p.x GROUP BY 1, 2""")
def m5_confusion_matrix(b):
    return M.confusion_matrix(b.pairs, best(b), len(LABELS))


@query(f"SELECT config, fold, {COUNTS} FROM ({BOTH}) JOIN ({FOLDS}) USING (grouping) GROUP BY GROUPING SETS ((config, fold), (config))")
def m6_sum_counts(b):
    rows = both_configs(b).join(C.make_folds(b.units, 5, seed=7), "grouping")
    counts = M.edge_counts(rows, rows, UNRELATED_IX, ["config", "fold", "grouping"]).drop("grouping")
    return M.sum_counts(counts, ["config"], "fold")


@query(f"""SELECT round(avg(CAST(g.parent = p.parent AS INTEGER)), 9) AS uas, round(avg(CAST(g.parent = p.parent AND g.label = p.label AS INTEGER)), 9) AS las,
           round(avg(CAST(g.label = p.label AS INTEGER)), 9) AS ls FROM ({GOLD_HEADS}) g JOIN ({PRED_HEADS}) p USING (grouping, child)""")
def m7_uas_las_ls(b):
    return rounded(M.uas_las_ls(heads(b, "target"), heads(b, "prediction")))


@query(f"""SELECT grouping, round(1 - avg(CAST(g.parent = p.parent AND g.label = p.label AS INTEGER)), 9) AS loss FROM ({GOLD_HEADS}) g JOIN ({PRED_HEADS}) p USING (grouping, child) GROUP BY 1""")
def m8_tree_loss(b):
    g, p = heads(b, "target"), heads(b, "prediction")
    return rounded(M.tree_loss(g, p, ["parent", "child", "label"]))


@query(f"""SELECT grouping, round(1 - avg(CASE WHEN g.parent <> p.parent THEN 0 WHEN g.label = p.label THEN 1 ELSE 0.5 END), 9) AS loss
           FROM ({GOLD_HEADS}) g JOIN ({PRED_HEADS}) p USING (grouping, child) GROUP BY 1""")
def m9_labelled_tree_loss(b):
    return rounded(M.labelled_tree_loss(heads(b, "target"), heads(b, "prediction")))


def predicted_spans(b):
    """The gold spans, some with another relation, without those that end at an even place of odd length."""
    changed = F.when((F.col("conv_id") + F.col("span_lo")) % 4 == 0, F.lit("narration")).otherwise(F.col("relation"))
    return b.spans.where("(span_hi + conv_id) % 5 <> 0").withColumn("relation", changed)


OTHER = "SELECT * REPLACE (CASE WHEN (conv_id + span_lo) % 4 = 0 THEN 'narration' ELSE relation END AS relation) FROM spans WHERE (span_hi + conv_id) % 5 <> 0"
PRF = """round(CASE WHEN pred = 0 THEN 0 ELSE tp / CAST(pred AS DOUBLE) END, 9) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE tp / CAST(gold AS DOUBLE) END, 9) AS recall,
    round(CASE WHEN pred + gold = 0 THEN 0 ELSE 2 * tp / CAST(pred + gold AS DOUBLE) END, 9) AS f1, gold AS support"""
PER_LABEL = f"""SELECT label, sum(tp) AS tp, sum(pred) AS pred, sum(gold) AS gold FROM (
    SELECT relation AS label, count(*) AS gold, 0 AS pred, 0 AS tp FROM spans GROUP BY 1
    UNION ALL SELECT relation, 0, count(*), 0 FROM ({OTHER}) GROUP BY 1
    UNION ALL SELECT relation, 0, 0, count(*) FROM (SELECT grouping, span_lo, span_hi, relation FROM spans INTERSECT SELECT grouping, span_lo, span_hi, relation FROM ({OTHER})) GROUP BY 1) GROUP BY 1"""


@query(f"SELECT label, {PRF.replace('gold AS support', 'gold::BIGINT AS support')} FROM ({PER_LABEL})")
def m10_structured_prf(b):
    g, p = (x.withColumnRenamed("relation", "label") for x in (b.spans, predicted_spans(b)))
    return rounded(M.structured_prf(g, p, ["span_lo", "span_hi"]))


def micro(metric: str, label: str, where: str = "true") -> str:
    return f"""SELECT '{metric}' AS metric, {PRF} FROM (SELECT (SELECT count(*) FROM spans WHERE {where}) AS gold, (SELECT count(*) FROM ({OTHER}) WHERE {where}) AS pred,
        (SELECT count(*) FROM (SELECT grouping, span_lo, span_hi, {label} AS l FROM spans WHERE {where} INTERSECT SELECT grouping, span_lo, span_hi, {label} FROM ({OTHER}) WHERE {where})) AS tp)"""


SPAN_LABELS = {"S": ("1", "span_lo < span_hi"), "S+N": ("nuclearity", "true"), "S+R": ("relation", "true"), "S+N+R": ("concat(relation, '-', nuclearity)", "true")}


@query(" UNION ALL ".join(micro(m, *x) for m, x in SPAN_LABELS.items()))
def m11_span_prf(b):
    each = [M.span_prf(b.spans, predicted_spans(b), m).withColumn("metric", F.lit(m)) for m in M.SPAN_METRICS]
    return rounded(P.stack(*each))


SIX = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
DETAIL = PRF.replace("gold AS support", "gold::BIGINT AS support").replace(", 9)", ", 15)")
WEIGHTED = ", ".join(f"round(sum({c} * support) / sum(support), 6)" for c in ("precision", "recall", "f1"))


@query(f"""WITH d AS (SELECT label, {DETAIL} FROM ({PER_LABEL})) SELECT label, {SIX}, support FROM d
           UNION ALL SELECT 'avg', {WEIGHTED}, sum(support)::BIGINT FROM d""")
def m12_span_prf_detailed(b):
    return rounded(M.span_prf_detailed(b.spans, predicted_spans(b), "S+R"), 6)


def span_count_sql(metric: str, label: str, where: str) -> str:
    side = lambda t: f"(SELECT DISTINCT grouping, span_lo, span_hi, {label} AS l, 1 AS one FROM {t} WHERE {where})"
    return f"""SELECT grouping, '{metric}' AS metric, count(*) FILTER (WHERE g.one = 1 AND p.one = 1) AS tpos, count(p.one) AS tpos_fpos, count(g.one) AS tpos_fneg
        FROM {side('spans')} g FULL JOIN {side(f'({OTHER})')} p USING (grouping, span_lo, span_hi, l) GROUP BY 1, 2"""


SPAN_COUNTS = " UNION ALL ".join(span_count_sql(m, *x) for m, x in SPAN_LABELS.items())


@query(SPAN_COUNTS)
def m13_span_counts(b):
    return M.span_counts(b.spans, predicted_spans(b))


@query("SELECT grouping, span_lo, span_hi FROM spans WHERE span_hi - span_lo > 1")
def m14_tree_spans(b):
    return M.tree_spans(b.spans.withColumn("depth", F.col("span_hi") - F.col("span_lo") - 1)).select("grouping", "span_lo", "span_hi")


@query(f"""SELECT grouping, round(1 - CAST(count(p.span_lo) AS DOUBLE) / count(*), 9) AS loss FROM (SELECT DISTINCT grouping, span_lo, span_hi, nuclearity, relation FROM spans) g
           LEFT JOIN (SELECT DISTINCT grouping, span_lo, span_hi, nuclearity, relation FROM ({OTHER})) p USING (grouping, span_lo, span_hi, nuclearity, relation) GROUP BY 1""")
def m15_span_loss(b):
    return rounded(M.span_loss(b.spans, predicted_spans(b)))


@query("""SELECT round(avg(r), 9) AS accuracy, round(avg(r) FILTER (WHERE n = 1), 9) AS accuracy_single FROM (
          SELECT grouping, m_target, count(*) FILTER (WHERE c_class = 'True') AS n, CAST(bool_or(c_class = 'True' AND d_last = 'True') AS INTEGER) AS r FROM instances GROUP BY 1, 2) WHERE n > 0""")
def m16_last_attach_accuracy(b):
    return rounded(M.last_attach_accuracy(b.instances))


ITEMS = """SELECT feature, value, yes FROM (SELECT c_class = 'True' AS yes, unnest([{names}]) AS feature, unnest([{values}]) AS value FROM instances {where})"""
OPEN = {"C#distance": "c_distance::VARCHAR", "D#same_sentence": "d_same_sentence", "D#LAST": "d_last", "D#kind": "d_kind"}
META = {"m#source": "m_source", "m#target": "m_target"}


def items_sql(names: dict[str, str], where: str = "") -> str:
    return ITEMS.format(names=", ".join(f"'{k}'" for k in names), values=", ".join(names.values()), where=where)


@query(f"""SELECT feature, value, count(*) AS n, round(avg(CAST(yes AS INTEGER)), 9) AS accuracy FROM ({items_sql(OPEN, "WHERE d_last = 'True'")}) GROUP BY 1, 2
           UNION ALL SELECT NULL, NULL, count(*), round(avg(CAST(c_class = 'True' AS INTEGER)), 9) FROM instances WHERE d_last = 'True'""")
def m17_accuracy_by_feature(b):
    return rounded(M.accuracy_by_feature(b.instances.where("d_last = 'True'")))


@query(f"SELECT feature, count(*) AS n FROM ({items_sql(OPEN | META | {'c#class': 'c_class'})}) GROUP BY 1")
def m18_feature_counts(b):
    return M.feature_counts(b.instances)


@query(f"""SELECT feature, value, n1, n0, CASE WHEN n0 = 0 THEN n1 + 1 ELSE round(n1 / CAST(n0 AS DOUBLE), 9) END AS odds FROM (
           SELECT feature, value, count(*) FILTER (WHERE yes) AS n1, count(*) FILTER (WHERE NOT yes) AS n0 FROM ({items_sql(OPEN | META)}) GROUP BY 1, 2)""")
def m19_odds_ratios(b):
    return rounded(M.odds_ratios(b.instances))


EDGE = f"SELECT config, {COUNTS} FROM ({BOTH}) GROUP BY 1"


@query(f"SELECT *, {prf_sql('tpos_attach')}, round(0.9 * CASE WHEN tpos_fneg = 0 THEN 0 ELSE tpos_attach / CAST(tpos_fneg AS DOUBLE) END, 9) AS recall_corrected FROM ({EDGE})")
def r1_prf(b):
    rows = both_configs(b)
    return rounded(R.with_prf(M.edge_counts(rows, rows, UNRELATED_IX, ["config"]), "tpos_attach", correction=0.9).drop("f1_corrected"))


UNDIRECTED = f"""SELECT config, {prf_sql('tpos_attach', 'undirected_')} FROM (SELECT config, count(*) FILTER (WHERE g AND p) AS tpos_attach, count(*) FILTER (WHERE p) AS tpos_fpos, count(*) FILTER (WHERE g) AS tpos_fneg
    FROM (SELECT config, grouping, least(parent, child) AS a, greatest(parent, child) AS b, bool_or(target <> 4) AS g, bool_or(prediction <> 4) AS p FROM ({BOTH}) GROUP BY 1, 2, 3, 4) GROUP BY 1)"""


@query(f"SELECT * FROM (SELECT *, {prf_sql('tpos_attach', 'directed_')}, {prf_sql('tpos_label', 'label_')} FROM ({EDGE})) JOIN ({UNDIRECTED}) USING (config)")
def r2_edge_report(b):
    rows = both_configs(b)
    return rounded(R.edge_report(rows, rows, UNRELATED_IX))


@query(f"SELECT metric, tpos, tpos_fpos, tpos_fneg, {prf_sql('tpos')} FROM (SELECT metric, sum(tpos)::BIGINT AS tpos, sum(tpos_fpos)::BIGINT AS tpos_fpos, sum(tpos_fneg)::BIGINT AS tpos_fneg FROM ({SPAN_COUNTS}) GROUP BY 1)")
def r3_span_report(b):
    return rounded(R.span_report(b.spans, predicted_spans(b)))


@query(f"SELECT *, {prf_sql('tpos')} FROM ({BY_LABEL})")
def r4_label_report(b):
    rows = best(b)
    return rounded(R.label_report(rows, rows, len(LABELS), UNRELATED_IX))


@query(f"SELECT total, round(tpos_attach / CAST(total AS DOUBLE), 9) AS attach_accuracy, round(tpos_label / CAST(total AS DOUBLE), 9) AS label_accuracy FROM ({UNIT_COUNTS})")
def r5_unit_report(b):
    rows = best(b)
    return rounded(R.unit_report(rows, rows, UNRELATED_IX))


@query(f"""SELECT config, directed_f1 AS edges_directed_f1, units_n FROM (SELECT config, {prf_sql('tpos_attach', 'directed_')} FROM ({EDGE}))
           JOIN (SELECT config, count(*) AS units_n FROM ({BOTH}) GROUP BY 1) USING (config)""")
def r6_combined_report(b):
    rows = both_configs(b)
    edges = R.edge_report(rows, rows, UNRELATED_IX).select("config", "directed_f1")
    units = rows.groupBy("config").agg(F.count(F.lit(1)).alias("n"))
    return rounded(R.combined_report({"edges": edges, "units": units}))


SLICED = f"""SELECT config, slice, {COUNTS} FROM (SELECT config, target, prediction, unnest(CASE WHEN ppos = 0 THEN ['whole', 'root'] WHEN psub = csub THEN ['whole', 'intra'] ELSE ['whole', 'inter'] END) AS slice
    FROM ({BOTH})) GROUP BY 1, 2"""


@query(f"SELECT *, {prf_sql('tpos_attach', 'attach_')}, {prf_sql('tpos_label', 'label_')} FROM ({SLICED})")
def r7_full_report(b):
    folds = C.make_folds(b.units, 5, seed=7)
    predictions = both_configs(b).join(folds, "grouping").select("config", "fold", "grouping", "parent", "child", "prediction")
    return rounded(R.full_report(b.pairs, predictions, folds, UNRELATED_IX))


#: A score per configuration and grouping.
SCORES = f"SELECT config, grouping, count(*) FILTER (WHERE target <> 4 AND prediction <> 4) / CAST(count(*) FILTER (WHERE target <> 4) AS DOUBLE) AS score FROM ({BOTH}) GROUP BY 1, 2"


def scores(b):
    rows = both_configs(b)
    counts = M.edge_counts(rows, rows, UNRELATED_IX, ["config", "grouping"])
    return R.with_prf(counts, "tpos_attach").select("config", "grouping", F.col("recall").alias("score"))


def paired(b):
    own = scores(b)
    side = lambda x: own.where(F.col("config") == x).select("grouping", F.col("score").alias(x))
    return side("best").join(side("half"), "grouping")


PAIRED = f"SELECT grouping, x.score AS best, y.score AS half FROM ({SCORES}) x JOIN ({SCORES}) y USING (grouping) WHERE x.config = 'best' AND y.config = 'half'"


@query(f"SELECT config, count(*) AS n, round(avg(score), 9) AS mean, round(stddev_samp(score) / sqrt(count(*)), 9) AS sem FROM ({SCORES}) GROUP BY 1")
def r8_standard_error(b):
    return rounded(R.standard_error(scores(b), "score", ["config"]))


@query(f"""SELECT count(*) AS n, round(least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)), 6) AS statistic FROM (
           SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / CAST(2 AS DOUBLE) AS r FROM (SELECT round(best - half, 12) AS d FROM ({PAIRED})) WHERE d <> 0)""")
def r10_wilcoxon(b):
    return R.wilcoxon(paired(b), "best", "half").select("n", F.round("statistic", 6).alias("statistic"))


@query(f"SELECT count(*) AS n, round(avg(best - half) / (stddev_samp(best - half) / sqrt(count(*))), 6) AS t FROM ({PAIRED})")
def r11_paired_t(b):
    return rounded(R.paired_t(paired(b), "best", "half"), 6)


@query(f"""SELECT count(*) FILTER (WHERE config = 'best') AS n1, count(*) FILTER (WHERE config <> 'best') AS n2,
           round(sum(r) FILTER (WHERE config = 'best') - count(*) FILTER (WHERE config = 'best') * (count(*) FILTER (WHERE config = 'best') + 1) / CAST(2 AS DOUBLE), 6) AS u
           FROM (SELECT config, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS r FROM ({SCORES}))""")
def r12_mann_whitney(b):
    return R.mann_whitney(scores(b), "score", "config", "best").select("n1", "n2", F.round("u", 6).alias("u"))


@query()
def r13_permutation_test(b):
    return R.permutation_test(scores(b), "score", "config", "best", n=200)


@query(f"""SELECT round((avg(score) FILTER (WHERE config = 'best') - avg(score) FILTER (WHERE config = 'half'))
           / sqrt(((count(*) FILTER (WHERE config = 'best') - 1) * var_samp(score) FILTER (WHERE config = 'best') + (count(*) FILTER (WHERE config = 'half') - 1) * var_samp(score) FILTER (WHERE config = 'half'))
           / (count(*) - 2)), 6) AS effect FROM ({SCORES})""")
def r14_effect_size(b):
    return rounded(R.effect_size(scores(b), "score", "config", "best"), 6)


@query(f"""SELECT 'best' AS a, 'half' AS b, count(*) AS n, round(least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)), 6) AS statistic FROM (
           SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / CAST(2 AS DOUBLE) AS r FROM (SELECT round(best - half, 12) AS d FROM ({PAIRED})) WHERE d <> 0)""")
def r15_significance_matrix(b):
    return R.significance_matrix(scores(b), "grouping", level=1.1).select("a", "b", "n", F.round("statistic", 6).alias("statistic"))


@query()
def r16_table_fingerprint(b):
    return R.table_fingerprint(b.pairs)


@query()
def r17_score_json(b):
    rows = both_configs(b)
    return R.score_json(R.edge_report(rows, rows, UNRELATED_IX), scores(b))


@query()
def r9_confidence_interval(b):
    mean, low, high = R.confidence_interval(scores(b).where("config = 'best'"), "score")
    return b.spark.createDataFrame([(mean, low, high)], "mean double, low double, high double")


def named(b, label):
    return P.with_label_names(best(b), LABELS, label)


@query("SELECT grouping, parent, child, 'within' AS kind FROM pairs WHERE target <> 4 AND psub = csub UNION ALL "
       "SELECT DISTINCT grouping, coalesce(psub, parent), csub, 'lifted' FROM pairs WHERE target <> 4 AND coalesce(psub, parent) <> csub")
def g1_select_links(b):
    links = P.attached_only(b.pairs, UNRELATED_IX).select("grouping", "parent", "child", "psub", "csub")
    within = G.select_links(links, "inter").select("grouping", "parent", "child", F.lit("within").alias("kind"))
    return within.unionByName(G.select_links(links, "intra").withColumn("kind", F.lit("lifted")))


T, PR = NAME.format("target"), NAME.format("prediction")


@query(f"""SELECT grouping, parent, child, CASE WHEN target <> 4 AND prediction <> 4 THEN 'both' WHEN target <> 4 THEN 'source' WHEN prediction <> 4 THEN 'target' ELSE 'neither' END AS status,
           CASE WHEN target <> 4 AND prediction <> 4 AND target <> prediction THEN concat({T}, ' | ', {PR}) WHEN target <> 4 THEN {T} ELSE {PR} END AS label FROM ({BEST_PARENT})""")
def g2_diff_links(b):
    return G.diff_links(named(b, "target"), named(b, "prediction"))


DOT = f"""WITH links AS (SELECT grouping, parent, child, CASE WHEN target <> 4 AND prediction <> 4 THEN 'solid' WHEN target <> 4 THEN 'dashed' ELSE 'dotted' END AS style,
        CASE WHEN target <> 4 AND prediction <> 4 AND target <> prediction THEN concat({T}, ' | ', {PR}) WHEN target <> 4 THEN {T} ELSE {PR} END AS label FROM ({BEST_PARENT}) WHERE target <> 4 OR prediction <> 4),
    edges AS (SELECT grouping, string_agg(e, chr(10) ORDER BY e) AS edges FROM (SELECT grouping, concat('  "', parent, '" -> "', child, '" [label="', label, '", style=', style, '];') AS e FROM links) GROUP BY 1),
    nodes AS (SELECT grouping, subgrouping, span_start, concat('    "', id, '" [label="', replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), ' '), '"];') AS n FROM units),
    clusters AS (SELECT grouping, min(span_start) AS lo, concat('  subgraph "cluster_', subgrouping, '" {{', chr(10), string_agg(n, chr(10) ORDER BY span_start, n), chr(10), '  }}') AS c FROM nodes GROUP BY grouping, subgrouping)
    SELECT e.grouping, concat('digraph "', e.grouping, '" {{', chr(10), string_agg(c, chr(10) ORDER BY lo, c), chr(10), any_value(edges), chr(10), '}}') AS dot FROM edges e JOIN clusters USING (grouping) GROUP BY 1"""


@query(DOT)
def g3_dot_text(b):
    return G.dot_text(b.units, G.diff_links(named(b, "target"), named(b, "prediction")))
