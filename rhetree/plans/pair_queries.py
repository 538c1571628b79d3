"""Queries of the pair operators and the plain decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from rhetree.operators import decode as D
from rhetree.operators import folds as C
from rhetree.operators import pairs as P

from .bridge import BEST, LABELS, ROOT_IX, UNRELATED_IX
from .registry import query

NAME = "list_extract(['__UNK__','elaboration','narration','continuation','UNRELATED','ROOT'], {} + 1)"
INTRA = "(ppos > 0 AND psub = csub)"
INTER = "(ppos > 0 AND psub <> csub)"


@query("""SELECT c.grouping, p.pair_ix, p.parent, p.child, p.csub, CASE WHEN p.ppos = 0 THEN 0 ELSE u.span_start END AS p_start,
          c.span_end AS c_end FROM pairs p JOIN units c ON c.id = p.child LEFT JOIN units u ON u.id = p.parent""")
def s6_link_units(b):
    out = P.link_units(b.units, b.pairs.select("pair_ix", "parent", "child"))
    return out.select(F.col("c_grouping").alias("grouping"), "pair_ix", "parent", "child", "csub", "p_start", "c_end")


@query("""SELECT grouping, pair_ix, parent, child, CASE WHEN ppos % 2 = 0 THEN 'UNRELATED' ELSE 'narration' END AS label FROM pairs""")
def s8_prediction_rows(b):
    from rhetree.sources.tables import prediction_rows

    triples = b.pairs.where("ppos % 2 = 1").select("grouping", "parent", "child", F.lit("narration").alias("label"))
    return prediction_rows(b.pairs, triples).select("grouping", "pair_ix", "parent", "child", "label")


@query(f"SELECT grouping, parent, child, {NAME.format('target')} AS label FROM pairs")
def s10_gold_predictions(b):
    from rhetree.sources.tables import gold_predictions

    return gold_predictions(b.pairs, LABELS)


@query("SELECT grouping, pair_ix, target FROM pairs")
def t1_stack(b):
    own = b.pairs.select("grouping", "pair_ix", "target", "ppos")
    return P.stack(own.where("ppos < 2"), own.where("ppos = 2"), own.where("ppos > 2")).drop("ppos")


@query("""SELECT u.grouping, u.id, count(*) AS n FROM units u JOIN pairs p ON p.grouping = u.grouping AND (p.parent = u.id OR p.child = u.id)
          WHERE p.cpos <= 2 AND p.ppos <= 3 GROUP BY 1, 2""")
def t2_select_pairs(b):
    own = P.select_pairs(b.weights, b.pairs.where("cpos <= 2 AND ppos <= 3"))
    units = P.mentioned_units(b.units, own)
    named = own.select("grouping", F.explode(F.array("parent", "child")).alias("id"))
    return units.join(named, ["grouping", "id"]).groupBy("grouping", "id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT unnest(['target_missing','target_range','label_0_unknown','label_unrelated','labels_empty','unknown_unit','grouping_mismatch']) AS rule,
          unnest([(SELECT count(*) FROM pairs WHERE target IS NULL), (SELECT count(*) FROM pairs WHERE target >= 6 OR target < 0), 0, 0, 0,
          (SELECT count(*) FROM pairs WHERE ppos > 0 AND parent NOT IN (SELECT id FROM units)), 0]) AS violations""")
def t3_validate_corpus(b):
    return P.validate_corpus(b.units, b.pairs, LABELS)


@query("SELECT grouping, count(*) AS n, 0::BIGINT AS n_mismatch FROM pairs GROUP BY 1")
def t4_groupings(b):
    out = P.groupings(P.link_units(b.units, b.pairs.select("parent", "child")))
    return out.groupBy("grouping").agg(F.count(F.lit(1)).alias("n"), F.count_if("mismatch").alias("n_mismatch"))


@query("SELECT grouping, pair_ix, target FROM pairs WHERE target <> 4")
def t5_attached_only(b):
    return P.attached_only(b.pairs, UNRELATED_IX).select("grouping", "pair_ix", "target")


@query("SELECT grouping, pair_ix, CASE WHEN target = 4 THEN -1 ELSE 1 END AS target FROM pairs")
def t6_for_attachment(b):
    return P.for_attachment(b.pairs, UNRELATED_IX).select("grouping", "pair_ix", "target")


@query("SELECT grouping, pair_ix, child FROM pairs WHERE ppos = 0")
def t7_fakeroot_pairs(b):
    return P.fakeroot_pairs(b.pairs).select("grouping", "pair_ix", "child")


@query(f"SELECT grouping, pair_ix, false AS with_root FROM pairs WHERE {INTRA} UNION ALL SELECT grouping, pair_ix, true FROM pairs WHERE {INTRA} OR ppos = 0")
def t8_intra_pairs(b):
    each = [P.intra_pairs(b.pairs, r).select("grouping", "pair_ix", F.lit(r).alias("with_root")) for r in (False, True)]
    return P.stack(*each)


@query(f"SELECT grouping, pair_ix, false AS with_root FROM pairs WHERE {INTER} UNION ALL SELECT grouping, pair_ix, true FROM pairs WHERE {INTER} OR ppos = 0")
def t9_inter_pairs(b):
    each = [P.inter_pairs(b.pairs, r).select("grouping", "pair_ix", F.lit(r).alias("with_root")) for r in (False, True)]
    return P.stack(*each)


@query(f"SELECT grouping, csub AS part, count(*) AS n, min(pair_ix) AS first_ix FROM pairs WHERE {INTRA} OR ppos = 0 GROUP BY 1, 2")
def t10_group_intra_pairs(b):
    return P.group_intra_pairs(b.pairs).groupBy("grouping", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pair_ix").alias("first_ix"))


@query("SELECT grouping, id, pos FROM units UNION ALL SELECT DISTINCT grouping, 'ROOT', 0::BIGINT FROM units")
def t11_unit_positions(b):
    return P.unit_positions(b.units)


@query("SELECT grouping, pair_ix FROM pairs WHERE abs(cpos - ppos) <= 2")
def t12_select_window(b):
    return P.select_window(P.with_positions(b.pairs, P.unit_positions(b.units)), 2).select("grouping", "pair_ix")


@query("""SELECT grouping, target, coalesce(max(CASE WHEN cpos < ppos THEN ppos - cpos END), 0) AS left_gap,
          coalesce(max(CASE WHEN cpos >= ppos THEN cpos - ppos END), 0) AS right_gap FROM pairs GROUP BY 1, 2""")
def t13_pairing_distances(b):
    return P.pairing_distances(P.with_positions(b.pairs, P.unit_positions(b.units)), ["grouping"])


@query("""SELECT target, coalesce(max(CASE WHEN cpos < ppos THEN ppos - cpos END), 0) AS left_gap,
          coalesce(max(CASE WHEN cpos >= ppos THEN cpos - ppos END), 0) AS right_gap FROM pairs GROUP BY 1""")
def t13_pairing_distances_corpus(b):
    return P.pairing_distances(b.pairs)


@query(f"SELECT grouping, pair_ix, {NAME.format('target')} AS label, target AS number FROM pairs")
def t14_label_names(b):
    named = P.with_label_names(b.pairs, LABELS)
    return P.with_label_numbers(named, LABELS, number="number").select("grouping", "pair_ix", "label", F.col("number").cast("long").alias("number"))


@query(f"""SELECT p.grouping, p.pair_ix, s.subset, s.row FROM pairs p LEFT JOIN (
             SELECT grouping, pair_ix, 1 AS subset, row_number() OVER (PARTITION BY grouping ORDER BY pair_ix) - 1 AS row FROM pairs WHERE target <> 4
             UNION ALL SELECT grouping, pair_ix, 0, rn FROM (SELECT grouping, pair_ix, target, row_number() OVER (PARTITION BY grouping ORDER BY pair_ix) - 1 AS rn
                                                             FROM pairs WHERE {INTRA}) WHERE target = 4) s
          ON s.grouping = p.grouping AND s.pair_ix = p.pair_ix""")
def t15_locate_in_subsets(b):
    out = P.locate_in_subsets(b.pairs, P.intra_pairs(b.pairs), P.attached_only(b.pairs, UNRELATED_IX))
    return out.select("grouping", "pair_ix", "subset", "row")


@query("SELECT grouping, pair_ix, w_continuation AS w0, w_elaboration AS w1, 0.0::DOUBLE AS w2, w_narration AS w3 FROM weights")
def t16_relabel(b):
    target = ["continuation", "elaboration", "new", "narration", "__UNK__", "UNRELATED", "ROOT"]
    out = P.relabel(b.weights, LABELS, target)
    return out.select("grouping", "pair_ix", *[F.get("label_w", F.lit(i)).alias(f"w{i}") for i in range(4)])


@query(f"SELECT grouping, parent, child, target FROM pairs WHERE target <> 4 AND {INTRA}")
def t17_select_in_pairs(b):
    gold = P.attached_only(b.pairs, UNRELATED_IX)
    return P.select_in_pairs(gold, P.intra_pairs(b.pairs)).select("grouping", "parent", "child", "target")


@query(f"SELECT grouping, parent, child, {NAME.format('target')} AS label FROM pairs WHERE target <> 4")
def t18_to_triples(b):
    return P.to_triples(b.pairs.withColumnRenamed("target", "prediction"), LABELS)


@query("SELECT grouping, pair_ix, target AS prediction FROM pairs")
def t19_from_triples(b):
    triples = P.to_triples(b.pairs.withColumnRenamed("target", "prediction"), LABELS)
    out = P.from_triples(b.pairs.drop("target"), triples, LABELS)
    return out.select("grouping", "pair_ix", F.col("prediction").cast("long").alias("prediction"))


@query(f"SELECT grouping, pair_ix, attach, {BEST} AS best_label FROM weights")
def t20_candidates(b):
    return P.candidates(b.weights).select("grouping", "pair_ix", "attach", "best_label")


@query("SELECT grouping, id, pos + 1 AS rank FROM units UNION ALL SELECT DISTINCT grouping, 'ROOT', 1::BIGINT FROM units")
def t21_sorted_units(b):
    return P.sorted_units(b.pairs, b.units)


@query(f"""SELECT p.grouping, p.parent, p.child, {BEST} AS best_label, attach FROM pairs p JOIN weights w
           ON w.grouping = p.grouping AND w.pair_ix = p.pair_ix WHERE p.target <> 4""")
def t22_pair_lookup(b):
    wanted = P.attached_only(b.pairs, UNRELATED_IX).select("grouping", "parent", "child")
    return P.pair_lookup(b.weights, wanted)


@query("SELECT grouping, pair_ix, round(attach * attach, 12) AS attach, round(w_narration * w_narration, 12) AS w2, 0 AS prediction FROM weights")
def t23_multiply_weights(b):
    once = P.multiply_weights(b.pairs, b.weights)
    out = P.multiply_weights(once, b.weights)
    return out.select("grouping", "pair_ix", F.round("attach", 12).alias("attach"), F.round(F.get("label_w", F.lit(2)), 12).alias("w2"), "prediction")


@query(f"""SELECT grouping, pair_ix, CASE WHEN {INTRA} THEN attach ELSE 0 END AS attach, CASE WHEN {INTRA} THEN 0 ELSE 4 END AS prediction FROM weights""")
def t24_select(b):
    return P.select(b.weights, P.is_intra(), UNRELATED_IX).select("grouping", "pair_ix", "attach", "prediction")


@query(f"SELECT grouping, pair_ix, CASE WHEN {INTER} THEN attach / 2 ELSE attach END AS attach FROM weights")
def t25_overlay_nonfixed(b):
    new = b.weights.withColumn("attach", F.col("attach") / 2)
    return P.overlay_nonfixed(b.weights, new, ~P.is_intra() & ~P.is_root()).select("grouping", "pair_ix", "attach")


INTRA_TARGETS = f"""SELECT p.grouping, p.pair_ix, CASE WHEN ppos = 0 AND h.child IS NULL THEN 5 WHEN {INTER} THEN 4 ELSE target END AS target
    FROM pairs p LEFT JOIN (SELECT DISTINCT grouping, child FROM pairs WHERE {INTRA} AND target <> 4) h ON h.grouping = p.grouping AND h.child = p.child"""


@query(INTRA_TARGETS)
def t26_intra_targets(b):
    return P.intra_targets(b.pairs, UNRELATED_IX, ROOT_IX).select("grouping", "pair_ix", "target")


@query(f"SELECT grouping, pair_ix, CASE WHEN attach > 0.5 THEN {BEST} ELSE 4 END AS prediction FROM weights")
def d1_decode_threshold(b):
    return D.decode_threshold(b.weights, UNRELATED_IX, 0.5).select("grouping", "pair_ix", "prediction")


@query(f"SELECT grouping, pair_ix, CASE WHEN cpos = ppos + 1 THEN {BEST} ELSE 4 END AS prediction FROM weights")
def d2_decode_last(b):
    return D.decode_last(b.weights, b.units, UNRELATED_IX).select("grouping", "pair_ix", "prediction")


@query(f"""SELECT w.grouping, pair_ix, CASE WHEN row_number() OVER (PARTITION BY w.grouping ORDER BY attach DESC, pair_ix) <= n.n THEN {BEST} ELSE 4 END AS prediction
           FROM weights w JOIN (SELECT grouping, count(*) + 1 AS n FROM units GROUP BY 1 HAVING count(*) > 0) n ON n.grouping = w.grouping""")
def d3_decode_as_many(b):
    return D.decode_as_many(b.weights, UNRELATED_IX).select("grouping", "pair_ix", "prediction")


@query(f"""SELECT grouping, pair_ix, CASE WHEN row_number() OVER (PARTITION BY grouping, child ORDER BY attach DESC, pair_ix) = 1 THEN {BEST} ELSE 4 END AS prediction FROM weights""")
def d4_decode_best_incoming(b):
    return D.decode_best_incoming(b.weights, UNRELATED_IX).select("grouping", "pair_ix", "prediction")


@query("""SELECT a.grouping, a.id AS one, b.id AS two FROM units a JOIN units b ON a.grouping = b.grouping AND a.id <> b.id
          WHERE NOT EXISTS (SELECT 1 FROM units m WHERE m.grouping = a.grouping AND m.id <> a.id AND m.id <> b.id
            AND ((a.span_end <= m.span_start AND m.span_start <= b.span_start) OR (a.span_end <= m.span_end AND m.span_end <= b.span_start)
              OR (b.span_end <= m.span_start AND m.span_start <= a.span_start) OR (b.span_end <= m.span_end AND m.span_end <= a.span_start)))
          OR (b.span_start <= a.span_start AND a.span_end <= b.span_end) OR (a.span_start <= b.span_start AND b.span_end <= a.span_end)""")
def d5_neighbours(b):
    return D.neighbours(b.units)


@query("""SELECT grouping, child, max(attach) AS best_attach, round(avg(attach), 9) AS average, max(max(attach)) OVER (PARTITION BY grouping) AS best_overall
          FROM weights GROUP BY 1, 2""")
def d11_heuristic_stats(b):
    return D.heuristic_stats(b.weights).withColumn("average", F.round("average", 9))


@query("SELECT grouping, pair_ix, round(ln(attach / (1 - attach)), 9) AS logit, round(ln(attach), 9) AS log, CASE WHEN ppos = 0 THEN -1e90 ELSE 1.0 END AS capped FROM weights")
def d12_cap_score(b):
    from rhetree.functions.columns import cap_score, logit, safe_log

    odd = F.when(F.col("ppos") == 0, F.lit(float("-inf"))).otherwise(F.lit(1.0))
    return b.weights.select(
        "grouping", "pair_ix", F.round(logit(F.col("attach")), 9).alias("logit"), F.round(safe_log(F.col("attach")), 9).alias("log"), cap_score(odd).alias("capped")
    )


FOLDS = "SELECT grouping, CAST((row_number() OVER (ORDER BY md5(concat('7|', grouping)), grouping) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT grouping FROM units)"


@query(FOLDS)
def c1_make_folds(b):
    return C.make_folds(b.units, 5, seed=7)


@query(f"SELECT grouping FROM ({FOLDS}) WHERE fold = 2")
def c2_fold_groupings(b):
    return C.fold_groupings(C.make_folds(b.units, 5, seed=7), 2)


@query(f"SELECT grouping, pair_ix, fold = 2 AS test FROM pairs JOIN ({FOLDS}) USING (grouping)")
def c3_train_test(b):
    folds = C.make_folds(b.units, 5, seed=7)
    each = [f(b.pairs, folds, 2).select("grouping", "pair_ix", F.lit(t).alias("test")) for f, t in ((C.test_rows, True), (C.train_rows, False))]
    return P.stack(*each)


LINE_WEIGHTS = """((p.doc_id * 7919 + p.pos * 104729 + c.pos * 1299709 + 17) % 1000003 + 1) / CAST(1000005 AS DOUBLE)"""


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS pos FROM documents),
           w AS (SELECT p.doc_id, p.pos AS ppos, c.pos AS cpos, {LINE_WEIGHTS} AS attach FROM l p JOIN l c ON p.doc_id = c.doc_id AND p.pos <> c.pos AND abs(p.pos - c.pos) <= 5)
           SELECT doc_id, cpos, ppos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cpos ORDER BY attach DESC, cpos * 1000000 + ppos) AS k FROM w) WHERE k = 1""")
def document_lines_window(b):
    """The lines of every document as units, candidate pairs in a window of five lines, the best parent of each line."""
    lines = b.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"))
    # a window needs no join on the document alone: each line names the places it may hang from
    near = F.filter(F.sequence(F.col("pos") - 5, F.col("pos") + 5), lambda x: x != F.col("pos"))
    pairs = lines.select("doc_id", F.col("pos").alias("cpos"), F.explode(near).alias("ppos"))
    there = lines.select("doc_id", F.col("pos").alias("ppos"))
    weights = pairs.join(there, ["doc_id", "ppos"]).select(
        F.col("doc_id").alias("grouping"), F.col("cpos").alias("child"), F.col("ppos").alias("parent"), (F.col("cpos") * 1000000 + F.col("ppos")).alias("pair_ix"),
        F.expr("((doc_id * 7919 + ppos * 104729 + cpos * 1299709 + 17) % 1000003 + 1) / CAST(1000005 AS DOUBLE)").alias("attach"),
    )
    out = D.decode_best_incoming(weights, UNRELATED_IX).where(F.col("prediction") != UNRELATED_IX)
    return out.select(F.col("grouping").alias("doc_id"), F.col("child").alias("cpos"), F.col("parent").alias("ppos"))
