"""Queries of the feature-map operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rhetree.operators import features as T

from .registry import query


@query("""SELECT grouping, pair_ix, CASE target WHEN 1 THEN 'subord' WHEN 2 THEN 'coord' WHEN 3 THEN 'coord' WHEN 4 THEN 'UNRELATED' ELSE 'ROOT' END AS kind FROM pairs""")
def t27_collapse_labels(b):
    from rhetree.operators.pairs import with_label_names

    from .bridge import LABELS

    return T.collapse_labels(with_label_names(b.pairs, LABELS), "subord_coord").select("grouping", "pair_ix", "kind")


KINDS = ", ".join(f"CASE WHEN d_kind = 'k{i}' THEN 'True' ELSE 'False' END AS k{i}" for i in range(4))


@query(f"SELECT grouping, pair_ix, d_last AS last, {KINDS}, 8::INTEGER + 2 AS n FROM instances")
def t28_binarise(b):
    out = T.binarise(b.instances)
    each = [F.col("feats")[f"D#kind=k{i}"].alias(f"k{i}") for i in range(4)]
    return out.select("grouping", "pair_ix", F.col("feats")["D#LAST"].alias("last"), *each, F.size("feats").alias("n"))


@query("SELECT grouping, pair_ix, CASE WHEN c_distance <= 1 THEN 'd1' WHEN c_distance <= 3 THEN 'd3' ELSE 'd6' END AS distance FROM instances")
def t29_discretize(b):
    out = T.discretize(b.instances, "C#distance", [1, 3, 6])
    return out.select("grouping", "pair_ix", F.col("feats")["C#distance"].alias("distance"))


@query("""SELECT grouping, pair_ix, 'C#distance,D#LAST,c#class,m#source,m#target' AS kept, 'D#kind,D#same_sentence,c#class,m#source,m#target' AS lost FROM instances""")
def t30_filter_features(b):
    names = lambda df, to: df.select("grouping", "pair_ix", F.array_join(F.sort_array(F.map_keys("feats")), ",").alias(to))
    kept = names(T.filter_features(b.instances, ["D#LAST"]), "kept")
    lost = names(T.filter_features(b.instances, ["D#LAST", "C#distance"], keep=False, continuous=False), "lost")
    return kept.join(lost, ["grouping", "pair_ix"])


@query("SELECT grouping, pair_ix FROM instances WHERE d_last = 'True' AND d_kind = 'k1'")
def t31_filter_instances(b):
    return T.filter_instances(b.instances, {"D#LAST": "True", "D#kind": "k1"}).select("grouping", "pair_ix")


@query("""SELECT grouping, pair_ix FROM (SELECT *, row_number() OVER (PARTITION BY grouping, d_kind ORDER BY run DESC) AS k FROM (
            SELECT grouping, d_kind, run, coalesce(max(pair_ix) FILTER (WHERE c_class = 'True'), min(pair_ix)) AS pair_ix FROM (
              SELECT *, sum(ch) OVER (PARTITION BY grouping ORDER BY pair_ix) AS run FROM (
                SELECT *, CASE WHEN lag(d_kind) OVER (PARTITION BY grouping ORDER BY pair_ix) = d_kind THEN 0 ELSE 1 END AS ch FROM instances)) GROUP BY 1, 2, 3)) WHERE k = 1""")
def t32_index_instances(b):
    rows = b.instances.withColumn("kind", F.col("feats")["D#kind"])
    return T.index_instances(rows, ["grouping", "kind"], "pair_ix").select("grouping", "pair_ix")


#: Every second unit stands for a complex unit whose head is the unit before it.
COMPLEX = "SELECT grouping, id, lag(id) OVER (PARTITION BY grouping ORDER BY pos) AS head, pos FROM units"


@query(f"""WITH h AS (SELECT grouping, id, head FROM ({COMPLEX}) WHERE pos % 2 = 0),
    o AS (SELECT i.*, coalesce(s.head, i.m_source) AS hs, coalesce(t.head, i.m_target) AS ht, s.head IS NOT NULL OR t.head IS NOT NULL AS cx FROM instances i
          LEFT JOIN h s ON s.grouping = i.grouping AND s.id = i.m_source LEFT JOIN h t ON t.grouping = i.grouping AND t.id = i.m_target),
    j AS (SELECT o.*, x.pair_ix AS bix, x.c_distance AS bd, x.c_class AS bc FROM o LEFT JOIN instances x ON x.grouping = o.grouping AND x.m_source = o.hs AND x.m_target = o.ht WHERE NOT cx OR hs <> ht)
    SELECT grouping, pair_ix, CASE WHEN cx AND bix IS NOT NULL THEN bd ELSE c_distance END::VARCHAR AS distance,
           CASE WHEN c_class = 'True' OR (cx AND bc = 'True') THEN 'True' ELSE 'False' END AS class
    FROM j WHERE cx OR NOT EXISTS (SELECT 1 FROM o u WHERE u.cx AND u.grouping = j.grouping AND u.hs = j.m_source AND u.ht = j.m_target)""")
def t33_propagate_heads(b):
    heads = b._sql(COMPLEX, units=b.units).where("pos % 2 = 0").select("grouping", "id", "head")
    rows = b.instances.select("grouping", "pair_ix", F.col("m_source").alias("source"), F.col("m_target").alias("target"), "feats")
    out = T.propagate_heads(rows, heads)
    return out.select("grouping", "pair_ix", F.col("feats")["C#distance"].alias("distance"), F.col("feats")["c#class"].alias("class"))


@query("""SELECT grouping, pair_ix, CASE WHEN d_last = 'True' THEN 'False' ELSE d_same_sentence END AS plain, CASE WHEN d_last = 'True' THEN d_same_sentence ELSE 'False' END AS split FROM instances""")
def t34_duplicate_features(b):
    out = T.duplicate_features(b.instances, "D#LAST")
    return out.select("grouping", "pair_ix", F.col("feats")["D#same_sentence"].alias("plain"), F.col("feats")["D#same_sentence_split"].alias("split"))


@query("SELECT grouping, pair_ix, concat('C#distance-D#kind=', d_kind) AS name, c_distance::VARCHAR AS value FROM instances")
def t35_cross_features(b):
    out = T.cross_features(b.instances, ["D#kind"])
    new = out.select("grouping", "pair_ix", F.explode("feats").alias("name", "value"))
    return new.where(F.col("name").startswith("C#distance-"))


@query("""SELECT grouping, pair_ix, c_distance::VARCHAR AS "C#distance", d_kind AS "D#kind", c_class AS "c#class", 'False' AS "D#none", '?' AS "C#none" FROM instances""")
def s13_dense_rows(b):
    return T.dense_rows(b.instances, ["C#distance", "D#kind", "c#class", "D#none", "C#none"], ["grouping", "pair_ix"])


LINE = "concat(CASE WHEN c_class = 'True' THEN '1' ELSE '0' END, ' C#distance:', c_distance, ' D#LAST=', d_last, ':1.0 D#kind=', d_kind, ':1.0 D#same_sentence=', d_same_sentence, ':1.0')"


@query(f"SELECT grouping, pair_ix, CASE WHEN c_class = 'True' THEN 1 ELSE 0 END AS class, {LINE} AS line FROM instances")
def s21_class_instances(b):
    return T.class_instances(b.instances).select("grouping", "pair_ix", "class", "line")


@query(f"""SELECT grouping, m_target AS unit, count(*) AS n, string_agg({LINE}, ';' ORDER BY {LINE} DESC) AS lines FROM instances GROUP BY 1, 2 HAVING bool_or(c_class = 'True')""")
def s22_rank_instances(b):
    return T.rank_instances(b.instances).withColumn("lines", F.array_join("lines", ";"))
