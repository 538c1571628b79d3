"""Queries of search decoders, parsers and learners."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rhetree.functions.columns import logistic
from rhetree.operators import decode as D
from rhetree.operators import folds as C
from rhetree.operators import learn as L
from rhetree.operators import mixing
from rhetree.operators import parse as S
from rhetree.operators import pairs as P
from rhetree.operators.decode_corpus import decode_corpus, decode_nbest, with_coordinating

from . import tree_sql
from .bridge import BEST, LABELS, ROOT_IX, UNRELATED_IX
from .pair_queries import INTER, INTRA, INTRA_TARGETS
from .registry import query

N = len(LABELS)
KEY = ["grouping", "pair_ix"]
FEATURES = ["distance", "forward", "same", "from_root", "kind"]


def decoded(b, decoder, **options):
    return decode_corpus(b.weights, b.units, decoder, UNRELATED_IX, **options).select(*KEY, "parent", "child", "prediction")


#: The candidates of whole documents, and of their parts.
DOCS = f"SELECT grouping AS g, ppos AS p, cpos AS c, pair_ix, attach, {BEST} IN (2, 3) AS coord FROM weights"
PARTS = f"SELECT csub AS g, ppos AS p, cpos AS c, pair_ix, attach FROM weights WHERE {INTRA} OR ppos = 0"


def marked(ctes: str, tree: str, label: str = BEST, recursive: str = "RECURSIVE ") -> str:
    """SQL of a decoder's predictions: the best label of the links in the CTE `tree`, UNRELATED for all others."""
    return f"""WITH {recursive}cand AS ({DOCS}), {ctes}
        SELECT w.grouping, w.pair_ix, w.parent, w.child, CASE WHEN t.pair_ix IS NULL THEN 4 ELSE {label} END AS prediction
        FROM weights w LEFT JOIN {tree} t ON t.g = w.grouping AND t.pair_ix = w.pair_ix"""


@query(marked(tree_sql.greedy("cand", "x"), "xgreedy"))
def d6_decode_greedy(b):
    return decoded(b, "greedy")


@query(marked(tree_sql.mst("cand", "x"), "xtree"))
def d7_decode_mst(b):
    return decoded(b, "mst")


LEFTMOST = "left_cand AS (SELECT g, p - 1 AS p, c - 1 AS c, pair_ix, attach FROM cand WHERE p > 0)"


@query(marked(f"{LEFTMOST}, {tree_sql.mst('left_cand', 'x')}", "xtree"))
def d7_decode_mst_leftmost(b):
    return decoded(b, "mst", root="leftmost")


@query(marked(tree_sql.msdag("cand", "x"), "xdag"))
def d8_decode_msdag(b):
    return decoded(b, "msdag")


@query(marked(tree_sql.eisner("cand", "x"), "xproj"))
def d9_decode_eisner(b):
    return decoded(b, "eisner")


@query(f"""SELECT grouping, pair_ix, CASE WHEN ppos < cpos AND row_number() OVER (PARTITION BY grouping, child ORDER BY CASE WHEN ppos < cpos THEN attach ELSE -1 END DESC, pair_ix) = 1 THEN {BEST} ELSE 4 END AS prediction
           FROM weights""")
def d10_decode_reading_order(b):
    return decoded(b, "reading_order", heuristic="best", frontier="none").select(*KEY, "prediction")


@query(marked(tree_sql.reading_order("cand", "x"), "xorder"))
def d10_decode_reading_order_frontier(b):
    return decoded(b, "reading_order", heuristic="best", frontier="simple")


@query()
def d10_decode_reading_order_beam(b):
    return decoded(b, "reading_order", frontier="simple", beam=20)


@query(f"""WITH RECURSIVE cand AS ({DOCS}), {tree_sql.reading_order("cand", "x", nbest=3, full=True)}
           SELECT g AS grouping, k, count(*) AS n_links, sum(pair_ix)::BIGINT AS links FROM xorder GROUP BY 1, 2""")
def d10_decode_reading_order_full_nbest(b):
    rows = with_coordinating(b.weights, LABELS)
    out = decode_nbest(rows, b.units, UNRELATED_IX, 3, frontier="full").where(F.col("prediction") != UNRELATED_IX)
    return out.groupBy("grouping", F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n_links"), F.sum("pair_ix").alias("links"))


def sentence(b):
    return D.decode_best_incoming(P.group_intra_pairs(b.weights), UNRELATED_IX)


SENTENCE = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY grouping, child ORDER BY attach DESC, pair_ix) = 1 THEN {BEST} ELSE 4 END AS sp FROM weights WHERE {INTRA} OR ppos = 0"""


@query("SELECT grouping, pair_ix, CASE WHEN target <> 4 THEN 2.0 ELSE 1.0 END::DOUBLE AS attach FROM pairs")
def p1_pipeline(b):
    steps = [("oracle", lambda r: L.oracle_attach(r, UNRELATED_IX)), ("more", lambda r: r.withColumn("attach", F.col("attach") + 1))]
    return S.Pipeline(steps).fit(b.pairs).transform(b.pairs).select(*KEY, "attach")


@query("SELECT grouping, pair_ix, round(attach * greatest(w_elaboration, w_narration, w_continuation), 12) AS attach FROM weights")
def p3_attach_times_best_label(b):
    return S.attach_times_best_label(b.weights).select(*KEY, F.round("attach", 12).alias("attach"))


def oracle_parser():
    """P2 with the gold links for weights."""
    return S.attach_pipeline(lambda r: L.oracle_attach(r, UNRELATED_IX), lambda r: D.decode_best_incoming(r, UNRELATED_IX))


@query(f"SELECT grouping, pair_ix, CASE WHEN target = 4 THEN 4 ELSE {BEST} END AS prediction FROM weights")
def p2_attach_pipeline(b):
    return oracle_parser().fit(b.weights).transform(b.weights).select(*KEY, "prediction")


@query(f"SELECT grouping, pair_ix, CASE WHEN cpos % 2 = 0 THEN 4 ELSE {BEST} END AS prediction FROM weights")
def p6_label_unknown(b):
    rows = b.weights.withColumn("prediction", F.when(F.col("cpos") % 2 == 0, UNRELATED_IX).otherwise(0))
    return S.label_unknown(rows).select(*KEY, "prediction")


@query(f"SELECT p.grouping, p.pair_ix, p.csub AS part, t.target FROM pairs p JOIN ({INTRA_TARGETS}) t ON t.grouping = p.grouping AND t.pair_ix = p.pair_ix WHERE {INTRA} OR ppos = 0")
def p7_intra_training_set(b):
    return S.intra_training_set(b.pairs, UNRELATED_IX, ROOT_IX).select(*KEY, "part", "target")


TAKEN = f"SELECT grouping, child FROM pairs WHERE {INTRA} AND target <> 4"


@query(f"""SELECT grouping, pair_ix, 'inter' AS mode FROM pairs WHERE {INTER} OR ppos = 0 UNION ALL SELECT grouping, pair_ix, 'head_to_head' FROM pairs
           WHERE ({INTER} OR ppos = 0) AND child NOT IN (SELECT child FROM ({TAKEN})) AND parent NOT IN (SELECT child FROM ({TAKEN}))""")
def p8_inter_training_set(b):
    each = [S.inter_training_set(b.pairs, m, UNRELATED_IX).select(*KEY, F.lit(m).alias("mode")) for m in ("inter", "head_to_head")]
    return P.stack(*each)


@query(f"SELECT w.grouping, w.pair_ix, CASE WHEN w.ppos = 0 THEN 4 ELSE coalesce(s.sp, 4) END AS prediction FROM weights w LEFT JOIN ({SENTENCE}) s ON s.grouping = w.grouping AND s.pair_ix = w.pair_ix")
def p11_sentences_only(b):
    return S.sentences_only(b.weights, sentence(b), UNRELATED_IX).select(*KEY, "prediction")


#: Pairs with what the sentences' parses say (sp, null if nothing), and attach and the best label with sentence links fixed.
FIXED = f"""SELECT w.*, s.sp, CASE WHEN w.ppos > 0 AND s.sp <> 4 THEN 1 ELSE w.attach END AS fixed_attach, CASE WHEN w.ppos > 0 AND s.sp <> 4 THEN s.sp ELSE {BEST} END AS fixed_label
           FROM weights w LEFT JOIN (SELECT grouping, pair_ix, sp FROM ({SENTENCE})) s ON s.grouping = w.grouping AND s.pair_ix = w.pair_ix"""


#: The pairs that head_to_head decodes, given j (pairs with what the sentences' parses say).
BETWEEN = """heads AS (SELECT grouping, child FROM j WHERE ppos = 0 AND sp <> 4),
    cand AS (SELECT grouping AS g, ppos AS p, cpos AS c, pair_ix, attach FROM j
             WHERE child IN (SELECT child FROM heads) AND (ppos = 0 OR parent IN (SELECT child FROM heads)))"""


def merged(j: str, ctes: str, tree: str, label: str) -> str:
    """SQL of what a decoder says of its candidates `cand`, and of what the sentences' parses say of all others."""
    return f"""WITH RECURSIVE {j}, {ctes}, doc AS (SELECT j.grouping, j.pair_ix, CASE WHEN t.pair_ix IS NULL THEN 4 ELSE {label} END AS dp
        FROM j JOIN cand ON cand.g = j.grouping AND cand.pair_ix = j.pair_ix LEFT JOIN {tree} t ON t.g = j.grouping AND t.pair_ix = j.pair_ix)
        SELECT j.grouping, j.pair_ix, coalesce(d.dp, CASE WHEN j.ppos > 0 THEN j.sp END, 4) AS prediction FROM j LEFT JOIN doc d ON d.grouping = j.grouping AND d.pair_ix = j.pair_ix"""


@query(merged(f"j AS ({FIXED})", f"{BETWEEN}, {tree_sql.mst('cand', 'x')}", "xtree", BEST))
def p12_head_to_head(b):
    out = S.head_to_head(b.weights, sentence(b), lambda r: decode_corpus(r, b.units, "mst", UNRELATED_IX), UNRELATED_IX)
    return out.select(*KEY, "prediction")


def best_links(rows):
    return D.decode_best_incoming(rows, UNRELATED_IX)


#: Predictions for the pairs that `doc` (grouping, pair_ix, dp) does not decide come from the sentences.
MERGED = "SELECT j.grouping, j.pair_ix, coalesce(d.dp, CASE WHEN j.ppos > 0 THEN j.sp END, 4) AS prediction FROM j LEFT JOIN doc d ON d.grouping = j.grouping AND d.pair_ix = j.pair_ix"
HEAD_TO_HEAD = f"""WITH j AS ({FIXED}), heads AS (SELECT grouping, child FROM j WHERE ppos = 0 AND sp <> 4),
    doc AS (SELECT grouping, pair_ix, CASE WHEN row_number() OVER (PARTITION BY grouping, child ORDER BY attach DESC, pair_ix) = 1 THEN {BEST} ELSE 4 END AS dp
            FROM j WHERE child IN (SELECT child FROM heads) AND (ppos = 0 OR parent IN (SELECT child FROM heads)))
    {MERGED}"""


@query(HEAD_TO_HEAD)
def p12_head_to_head_best(b):
    return S.head_to_head(b.weights, sentence(b), best_links, UNRELATED_IX).select(*KEY, "prediction")


FRONTIERS = f"""WITH RECURSIVE l AS (SELECT grouping, parent, ppos, child, cpos FROM pairs WHERE {INTRA} AND target <> 4),
    steps AS (SELECT grouping, ppos AS at, max(cpos) AS nxt, 'right' AS side FROM l WHERE ppos < cpos GROUP BY 1, 2 UNION ALL SELECT grouping, ppos, min(cpos), 'left' FROM l WHERE ppos > cpos GROUP BY 1, 2),
    f AS (SELECT u.grouping, u.pos AS at, s.side FROM units u, (VALUES ('left'), ('right')) s(side) WHERE u.id NOT IN (SELECT child FROM l)
          UNION ALL SELECT f.grouping, n.nxt, f.side FROM f JOIN steps n ON n.grouping = f.grouping AND n.at = f.at AND n.side = f.side)
    SELECT DISTINCT f.grouping, u.id AS unit, f.side FROM f JOIN units u ON u.grouping = f.grouping AND u.pos = f.at"""


@query(FRONTIERS)
def p13_frontiers(b):
    return S.frontiers(b.pairs, "target", UNRELATED_IX)


#: The pairs that frontier_to_head decodes, given j.
CHOSEN = f"""l AS (SELECT grouping, parent, ppos, child, cpos FROM j WHERE {INTRA} AND sp <> 4),
    steps AS (SELECT grouping, ppos AS at, max(cpos) AS nxt, 'right' AS side FROM l WHERE ppos < cpos GROUP BY 1, 2 UNION ALL SELECT grouping, ppos, min(cpos), 'left' FROM l WHERE ppos > cpos GROUP BY 1, 2),
    heads AS (SELECT * FROM units WHERE id NOT IN (SELECT child FROM l)),
    f AS (SELECT u.grouping, u.pos AS at, s.side FROM heads u, (VALUES ('left'), ('right')) s(side)
          UNION ALL SELECT f.grouping, n.nxt, f.side FROM f JOIN steps n ON n.grouping = f.grouping AND n.at = f.at AND n.side = f.side),
    chosen AS (SELECT * FROM j WHERE cpos IN (SELECT pos FROM heads h WHERE h.grouping = j.grouping) AND (ppos = 0 OR (psub <> csub AND
                   EXISTS (SELECT 1 FROM f WHERE f.grouping = j.grouping AND f.at = j.ppos AND f.side = CASE WHEN j.cpos > j.ppos THEN 'right' ELSE 'left' END)))
               UNION ALL SELECT * FROM j WHERE {INTRA} AND sp <> 4 AND
                   EXISTS (SELECT 1 FROM f p JOIN f c ON c.grouping = p.grouping AND c.side = p.side WHERE p.grouping = j.grouping AND p.at = j.ppos AND c.at = j.cpos))"""
FRONTIER_TO_HEAD = f"""WITH RECURSIVE j AS ({FIXED}), {CHOSEN},
    doc AS (SELECT grouping, pair_ix, CASE WHEN row_number() OVER (PARTITION BY grouping, child ORDER BY fixed_attach DESC, pair_ix) = 1 THEN fixed_label ELSE 4 END AS dp FROM chosen)
    {MERGED}"""
TO_HEADS = f"{CHOSEN}, cand AS (SELECT grouping AS g, ppos AS p, cpos AS c, pair_ix, fixed_attach AS attach FROM chosen), {tree_sql.mst('cand', 'x')}"


@query(merged(f"j AS ({FIXED})", TO_HEADS, "xtree", "fixed_label"))
def p14_frontier_to_head(b):
    out = S.frontier_to_head(b.weights, sentence(b), lambda r: decode_corpus(r, b.units, "mst", UNRELATED_IX), N, UNRELATED_IX)
    return out.select(*KEY, "prediction")


@query(FRONTIER_TO_HEAD)
def p14_frontier_to_head_best(b):
    return S.frontier_to_head(b.weights, sentence(b), best_links, N, UNRELATED_IX).select(*KEY, "prediction")


@query(f"""SELECT w.grouping, w.pair_ix, CASE WHEN w.ppos > 0 AND s.sp <> 4 THEN 1 ELSE w.attach END AS attach, CASE WHEN w.ppos > 0 AND s.sp <> 4 THEN CASE WHEN s.sp = 2 THEN 1 ELSE 0 END ELSE w.w_narration END AS w2
           FROM weights w LEFT JOIN ({SENTENCE}) s ON s.grouping = w.grouping AND s.pair_ix = w.pair_ix""")
def p15_fix_intra_links(b):
    out = S.fix_intra_links(S.recombine(b.weights, sentence(b), UNRELATED_IX), N, UNRELATED_IX)
    return out.select(*KEY, "attach", F.get("label_w", F.lit(2)).alias("w2"))


@query(f"""WITH RECURSIVE j AS ({FIXED}), cand AS (SELECT grouping AS g, ppos AS p, cpos AS c, pair_ix, fixed_attach AS attach FROM j), {tree_sql.eisner("cand", "x")}
           SELECT j.grouping, j.pair_ix, CASE WHEN t.pair_ix IS NULL THEN 4 ELSE fixed_label END AS prediction FROM j LEFT JOIN xproj t ON t.g = j.grouping AND t.pair_ix = j.pair_ix""")
def p16_soft(b):
    return S.soft(b.weights, sentence(b), lambda r: decode_corpus(r, b.units, "eisner", UNRELATED_IX), N, UNRELATED_IX).select(*KEY, "prediction")


@query(f"SELECT grouping, pair_ix, CASE WHEN row_number() OVER (PARTITION BY grouping, child ORDER BY fixed_attach DESC, pair_ix) = 1 THEN fixed_label ELSE 4 END AS prediction FROM ({FIXED})")
def p16_soft_best(b):
    return S.soft(b.weights, sentence(b), best_links, N, UNRELATED_IX).select(*KEY, "prediction")


@query(f"""SELECT grouping, CASE WHEN target <> 4 THEN 'lost' ELSE 'hallucinated' END AS kind, CASE WHEN psub = csub THEN 'intra' ELSE 'inter' END AS level, count(*) AS n FROM
           (SELECT *, CASE WHEN row_number() OVER (PARTITION BY grouping, child ORDER BY attach DESC, pair_ix) = 1 THEN {BEST} ELSE 4 END AS p FROM weights) WHERE ppos > 0 AND (target <> 4) <> (p <> 4) GROUP BY 1, 2, 3""")
def p17_lost_and_hallucinated(b):
    return S.lost_and_hallucinated(D.decode_best_incoming(b.weights, UNRELATED_IX), UNRELATED_IX)


@query(f"""SELECT grouping, 0 AS k, count(*) AS n FROM (SELECT DISTINCT grouping, csub, parent, child FROM ({SENTENCE}) WHERE sp <> 4) GROUP BY 1""")
def p18_zip_nbest(b):
    rows = sentence(b).where(F.col("prediction") != UNRELATED_IX).withColumns({"k": F.lit(0), "label": F.col("prediction")})
    return S.zip_nbest(rows).select("grouping", "k", F.size("links").cast("long").alias("n"))


#: Pairs with what trees of the parts say, null outside them.
TREES = f"""parts AS ({PARTS}), {tree_sql.mst("parts", "s")},
    j AS (SELECT w.*, CASE WHEN o.pair_ix IS NULL THEN NULL WHEN t.pair_ix IS NULL THEN 4 ELSE {BEST} END AS sp FROM weights w
          LEFT JOIN parts o ON o.g = w.csub AND o.pair_ix = w.pair_ix LEFT JOIN stree t ON t.g = w.csub AND t.pair_ix = w.pair_ix)"""


@query(merged(TREES, f"{BETWEEN}, {tree_sql.mst('cand', 'x')}", "xtree", BEST))
def p10_two_level(b):
    decode_part = lambda r: decode_corpus(r, b.units, "mst", UNRELATED_IX, key=("grouping", "part"))
    combine = lambda w, s: S.head_to_head(w, s, lambda r: decode_corpus(r, b.units, "mst", UNRELATED_IX), UNRELATED_IX)
    return S.two_level_transform(b.weights, decode_part, combine).select(*KEY, "prediction")


@query(HEAD_TO_HEAD)
def p10_two_level_best(b):
    combine = lambda w, s: S.head_to_head(w, s, best_links, UNRELATED_IX)
    return S.two_level_transform(b.weights, best_links, combine).select(*KEY, "prediction")


def featured(b):
    """Pairs with a few features; the gold links of the bridge depend on the distance."""
    rows = b.pairs.withColumns(
        {
            "distance": F.abs(F.col("cpos") - F.col("ppos")).cast("double"), "forward": (F.col("cpos") > F.col("ppos")).cast("double"),
            "same": P.is_intra().cast("double"), "from_root": (F.col("ppos") == 0).cast("double"), "kind": ((F.col("conv_id") + F.col("ppos") + F.col("cpos")) % 3).cast("double"),
        }
    )
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def models(b):
    rows = featured(b)
    return rows, L.fit_attach(rows, UNRELATED_IX, maxIter=10), L.fit_label(rows, UNRELATED_IX, N, maxIter=10, family="multinomial")


@query()
def l1_l2_attach_scores(b):
    rows = featured(b)
    return L.fit_attach(rows, UNRELATED_IX, maxIter=10).transform(rows).select(*KEY, F.round("attach", 4).alias("attach"))


@query()
def l3_l4_label_scores(b):
    rows, _, label = models(b)
    return label.transform(rows).select(*KEY, *[F.round(F.get("label_w", F.lit(i)), 4).alias(f"w{i}") for i in range(N)])


@query("SELECT grouping, pair_ix, CASE WHEN target = 4 THEN 0 ELSE 1 END::DOUBLE AS attach FROM pairs")
def l5_oracle_attach(b):
    return L.oracle_attach(b.pairs, UNRELATED_IX).select(*KEY, "attach")


@query("SELECT grouping, pair_ix, CASE WHEN target = 4 THEN 1 ELSE 0 END::DOUBLE AS w0, CASE WHEN target = 2 THEN 1 ELSE 0 END::DOUBLE AS w2 FROM pairs")
def l6_oracle_label(b):
    return L.oracle_label(b.pairs, N, UNRELATED_IX).select(*KEY, F.get("label_w", F.lit(0)).alias("w0"), F.get("label_w", F.lit(2)).alias("w2"))


@query()
def l7_l8_l9_features(b):
    _, attach, label = models(b)
    return L.discriminating_features(b.spark, attach, label, FEATURES, LABELS, 3)


def item_rows(b):
    """Pairs with their features as sparse items."""
    from pyspark.ml.functions import vector_to_array

    return featured(b).withColumn("items", L.sparse_items(vector_to_array("features")))


@query()
def l10_l11_linear_weights(b):
    rows = item_rows(b).select(
        F.pmod(F.xxhash64("grouping"), F.lit(4)).alias("part"), F.struct("grouping", "pair_ix").alias("seq"), F.when(F.col("target") == UNRELATED_IX, -1.0).otherwise(1.0).alias("y"), "items"
    )
    each = [mixing.train_linear(rows, k, epochs=2).withColumn("learner", F.lit(k)) for k in ("perceptron", "pa", "pa2")]
    return P.stack(*each).select("learner", "feature_ix", "w")


@query()
def l12_l13_structured_weights(b):
    rows = item_rows(b).select(*KEY, "parent", "child", "items", (F.col("target") != UNRELATED_IX).alias("gold"))

    def best_parents(doc, scores):
        import numpy as np

        # the first of the best of each child
        _, child = np.unique(doc["child"].to_numpy(str), return_inverse=True)
        order = np.lexsort((-scores, child))
        chosen = np.zeros(len(doc), bool)
        chosen[order[np.diff(child[order], prepend=-1) > 0]] = True
        return chosen

    each = [mixing.train_structured(rows, best_parents, 4, k, epochs=2).withColumn("learner", F.lit(k)) for k in ("perceptron", "pa", "pa2")]
    return P.stack(*each).select("learner", "feature_ix", "w")


LONG = "SELECT grouping, pair_ix, 0 AS feature_ix, abs(cpos - ppos)::DOUBLE AS value FROM pairs UNION ALL SELECT grouping, pair_ix, 1, CASE WHEN cpos > ppos THEN 1 ELSE 0 END FROM pairs"


@query(f"""SELECT grouping, pair_ix, round(s, 9) AS score, CASE WHEN s > 0 THEN 1 ELSE -1 END AS sign, round(1 / (1 + exp(-s)), 9) AS p
           FROM (SELECT grouping, pair_ix, sum(value * CASE feature_ix WHEN 0 THEN -0.5 ELSE 0.8 END::DOUBLE) AS s FROM ({LONG}) GROUP BY 1, 2)""")
def l14_l15_margin(b):
    one = b.pairs.select(*KEY, F.lit(0).alias("feature_ix"), F.abs(F.col("cpos") - F.col("ppos")).cast("double").alias("value"))
    two = b.pairs.select(*KEY, F.lit(1).alias("feature_ix"), (F.col("cpos") > F.col("ppos")).cast("double").alias("value"))
    weights = b.spark.createDataFrame([(0, -0.5), (1, 0.8)], "feature_ix int, w double")
    out = L.margin(one.unionByName(two), weights)
    return out.select(*KEY, F.round("score", 9).alias("score"), "sign", F.round(logistic(F.col("score")), 9).alias("p"))


def trained(b, decoder):
    def run(train, test):
        attach, label = L.fit_attach(train, UNRELATED_IX, maxIter=5), L.fit_label(train, UNRELATED_IX, N, maxIter=5, family="multinomial")
        parser = S.joint_pipeline(attach, label, decoder)
        return parser.transform(test).select(*KEY, "parent", "child", "target", "prediction")

    return run


@query()
def c4_p2_p4_cross_validate(b):
    configs = {
        "best": trained(b, lambda r: D.decode_best_incoming(r, UNRELATED_IX)),
        "mst": trained(b, lambda r: decode_corpus(r, b.units, "mst", UNRELATED_IX)),
        "attach": lambda train, test: S.attach_pipeline(L.fit_attach(train, UNRELATED_IX, maxIter=5), lambda r: D.decode_best_incoming(r, UNRELATED_IX)).transform(test).select(
            *KEY, "parent", "child", "target", "prediction"
        ),
    }
    return C.cross_validate(featured(b), C.make_folds(b.units, 2, seed=7), configs)


OWN = f"SELECT grouping, pair_ix, (conv_id % 3)::INTEGER AS fold, CASE WHEN target = 4 THEN 4 ELSE {BEST} END AS gold, CASE WHEN attach > 0.5 THEN {BEST} ELSE 4 END AS half FROM weights"


@query(f"""SELECT 'gold' AS config, grouping, pair_ix, fold, gold AS prediction FROM ({OWN}) UNION ALL SELECT 'half', grouping, pair_ix, fold, half FROM ({OWN})
           UNION ALL SELECT 'gold', grouping, pair_ix, NULL, gold FROM ({OWN}) UNION ALL SELECT 'half', grouping, pair_ix, NULL, half FROM ({OWN})""")
def c4_cross_validate_and_test(b):
    """Folds, and the parsers learned from all pairs on a test set (here the same documents)."""
    configs = {
        "gold": lambda train, rows: oracle_parser().fit(train).transform(rows).select(*KEY, "prediction"),
        "half": lambda train, rows: D.decode_threshold(rows, UNRELATED_IX, 0.5).select(*KEY, "prediction"),
    }
    folds = b.units.select("grouping", (F.col("conv_id") % 3).cast("int").alias("fold")).distinct()
    return C.cross_validate(b.weights, folds, configs, test=b.weights)


@query()
def p5_p9_two_level_fit(b):
    decode = lambda r: D.decode_best_incoming(r, UNRELATED_IX)

    def fit(rows):
        attach, label = L.fit_attach(rows, UNRELATED_IX, maxIter=5), L.fit_label(rows, UNRELATED_IX, N, maxIter=5, family="multinomial")
        return S.postlabel_pipeline(attach, label, decode, UNRELATED_IX).transform

    rows = featured(b)
    intra, inter = S.two_level_fit(fit, rows, "inter", UNRELATED_IX, ROOT_IX)
    sent = intra(P.group_intra_pairs(rows))
    return S.head_to_head(rows, sent, inter, UNRELATED_IX).select(*KEY, "prediction")
