"""Queries of the corpus-preparation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rhetree.operators import text as X

from .bridge import LABELS, UNRELATED_IX
from .pair_queries import NAME
from .registry import query

DOCS = "SELECT grouping, string_agg(text, chr(10) ORDER BY pos) AS text FROM units GROUP BY 1"
#: Gazetteer: lemmas of `benchmark` of two to four letters; the type is their length.
GAZETTEER = "SELECT DISTINCT lower(w) AS form, concat('t', length(w)) AS major_type FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) BETWEEN 2 AND 4"
#: Tokens with their places in the document.
PLACED = "SELECT t.*, u.span_start + tok_start AS s, u.span_start + tok_start + length(form) AS e FROM tagged t JOIN units u ON u.id = t.unit_id"


def gazetteer(b):
    words = b.table("benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("length(w) BETWEEN 2 AND 4")
    return words.select(F.lower("w").alias("form"), F.concat(F.lit("t"), F.length("w")).alias("major_type")).distinct()


def placed(b):
    units = b.units.select(F.col("id").alias("unit_id"), "span_start")
    out = b.tagged.join(units, "unit_id")
    return out.select(*b.tagged.columns, (F.col("span_start") + F.col("tok_start")).alias("start")).withColumn("end", F.col("start") + F.length("form"))


def relations(b):
    from rhetree.operators.pairs import attached_only, with_label_names

    own = with_label_names(attached_only(b.pairs, UNRELATED_IX), LABELS)
    return own.select("grouping", F.col("parent").alias("arg1"), F.col("child").alias("arg2"), F.col("label").alias("type"))


REL = f"SELECT grouping, parent AS arg1, child AS arg2, {NAME.format('target')} AS type FROM pairs WHERE target <> 4"


@query("SELECT grouping, id, text AS unit_text FROM units")
def x1_unit_text(b):
    texts = b.units.groupBy("grouping").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return X.unit_text(b.units.drop("text"), texts, "grouping").select("grouping", "id", "unit_text")


@query(f"SELECT u.id AS unit_id, count(*) AS n, min(t.s) AS first FROM units u JOIN ({PLACED}) t ON t.grouping = u.grouping AND u.span_start <= t.s AND t.e <= u.span_end GROUP BY 1")
def x2_unit_tokens(b):
    spans = placed(b).select("grouping", "start", "end", "tok_ix")
    return X.within_units(b.units, spans).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


@query("""SELECT m.complex_id, u.id, u.pos FROM (SELECT grouping, concat('x_', grouping, '_', floor(pos / 3)::BIGINT) AS complex_id, id FROM units) m JOIN units u ON u.id = m.id""")
def x3_complex_unit_members(b):
    key = F.concat(F.lit("x_"), "grouping", F.lit("_"), F.floor(F.col("pos") / 3).cast("string"))
    members = b.units.groupBy("grouping", key.alias("id")).agg(F.collect_list("id").alias("members"))
    return X.complex_unit_members(members, b.units).select("complex_id", "id", "pos")


DOWN = """WITH RECURSIVE down AS (SELECT unit_id AS s, head_ix AS tok_ix, tok_ix AS dependent FROM tagged WHERE head_ix >= 0
    UNION ALL SELECT d.s, t.head_ix, d.dependent FROM down d JOIN tagged t ON t.unit_id = d.s AND t.tok_ix = d.tok_ix WHERE t.head_ix >= 0)"""


@query(f"""{DOWN} SELECT t.unit_id, t.tok_ix, coalesce(n, 0) AS n_dependents, coalesce(y, 0) AS yield_length FROM tagged t
           LEFT JOIN (SELECT s, tok_ix, count(*) AS n, max(dependent) - min(dependent) AS y FROM down GROUP BY 1, 2) d ON d.s = t.unit_id AND d.tok_ix = t.tok_ix""")
def x4_token_dependents(b):
    return X.token_dependents(b.tagged.where("form IS NOT NULL"))


@query("""WITH RECURSIVE up AS (SELECT unit_id AS s, tok_ix, head_ix, 0 AS step, '' AS tag FROM tagged
          UNION ALL SELECT u.s, u.tok_ix, t.head_ix, u.step + 1, t.cpos_tag FROM up u JOIN tagged t ON t.unit_id = u.s AND t.tok_ix = u.head_ix)
          SELECT s AS unit_id, tok_ix, coalesce(string_agg(tag, '/' ORDER BY step) FILTER (WHERE step > 0), '') AS path FROM up GROUP BY 1, 2""")
def x5_path_to_root(b):
    return X.path_to_root(b.tagged).withColumn("path", F.array_join("path", "/"))


@query(f"""{DOWN} SELECT t.unit_id, t.tok_ix, least(t.tok_ix, coalesce(lo, t.tok_ix)) AS first_ix, greatest(t.tok_ix, coalesce(hi, t.tok_ix)) AS last_ix FROM tagged t
           LEFT JOIN tagged g ON g.unit_id = t.unit_id AND g.tok_ix = t.head_ix
           LEFT JOIN (SELECT s, tok_ix, min(dependent) AS lo, max(dependent) AS hi FROM down GROUP BY 1, 2) d ON d.s = t.unit_id AND d.tok_ix = t.tok_ix
           WHERE (t.cpos_tag = 'N' AND coalesce(g.cpos_tag, '') <> 'N') OR (t.cpos_tag = 'PRO' AND t.lemma NOT IN ('qui', 'que', 'dont', 'who', 'which'))""")
def x6_mentions(b):
    return X.mentions(b.tagged).select("unit_id", "tok_ix", "first_ix", "last_ix")


@query("""SELECT unit_id, tok_ix, cpos_tag = 'PRO' AS is_pronoun, cpos_tag = 'N' AND regexp_matches(form, '^\\p{Lu}') AS is_name,
          cpos_tag = 'N' AND lower(form) IN ('le', 'la', 'les', 'l''', 'the') AS is_definite FROM tagged""")
def x7_mention_flags(b):
    rows = b.tagged.withColumns({"first_form": F.col("form"), "n_tokens": F.lit(1)})
    return X.mention_flags(rows).select("unit_id", "tok_ix", "is_pronoun", "is_name", "is_definite")


#: Mentions with attributes of their heads and of first tokens, for both engines.
MENTIONED = """SELECT unit_id, tok_ix, form, CASE WHEN cpos_tag = 'PRO' AND tok_ix % 2 = 0 THEN 'CL' ELSE cpos_tag END AS cpos,
    CASE WHEN cpos_tag = 'PRO' AND tok_ix % 2 = 0 THEN CASE length(form) % 3 WHEN 0 THEN 'CLS' WHEN 1 THEN 'CLO' ELSE 'CLR' END WHEN cpos_tag = 'N' AND form <> lemma THEN 'NPP' ELSE cpos_tag END AS pos,
    CASE WHEN tok_ix % 3 < 2 THEN 'DET' ELSE 'N' END AS first_pos, CASE tok_ix % 4 WHEN 0 THEN 'son' WHEN 1 THEN 'ce' ELSE lemma END AS first_lemma,
    CASE tok_ix % 5 WHEN 0 THEN 'def' WHEN 1 THEN 'ind' END AS first_s, tok_ix % 4 + 1 AS n_tokens FROM tagged"""
TYPES = """cpos IN ('PRO', 'CL') AS is_pro, form IN ('Il', 'il') AS is_il, cpos = 'CL' AS is_cl_pro, pos IN ('CLS', 'CLO') AS is_non_refl_cl_pro, pos = 'NPP' AS is_name,
    pos = 'NPP' AND n_tokens = 1 AS is_short_name, first_pos = 'DET' AND coalesce(first_s = 'def', false) AS is_def_np, first_pos = 'DET' AND coalesce(first_s = 'def', false) AND n_tokens < 3 AS is_short_def_np,
    first_pos = 'DET' AND first_lemma = 'ce' AS is_dem_np, first_pos = 'DET' AND first_lemma = 'ce' AND n_tokens < 3 AS is_short_dem_np,
    first_pos = 'DET' AND coalesce(first_s = 'ind', false) AS is_indef_np, first_pos = 'DET' AND first_lemma = 'son' AS is_poss_np"""


@query(f"SELECT unit_id, tok_ix, {TYPES} FROM ({MENTIONED})")
def x7_mention_types(b):
    out = X.mention_types(b._sql(MENTIONED, tagged=b.tagged))
    return out.select("unit_id", "tok_ix", *[c for c in out.columns if c.startswith("is_")])


@query("""SELECT unit_id, tok_ix, CASE WHEN tok_ix % 5 = 0 THEN 'm' WHEN lemma IN ('il', 'ils', 'lui', 'he', 'him') THEN 'm' WHEN lemma IN ('elle', 'elles', 'she', 'her') THEN 'f' ELSE 'unk' END AS gender,
          CASE WHEN tok_ix % 7 = 0 THEN 'p' WHEN lemma IN ('ils', 'elles', 'nous', 'vous', 'les', 'they', 'we') THEN 'p'
               WHEN lemma IN ('il', 'elle', 'je', 'tu', 'on', 'lui', 'he', 'she', 'it', 'i') THEN 's' ELSE 'unk' END AS number FROM tagged""")
def x8_gender_number(b):
    feats = F.create_map(F.lit("g"), F.when(F.col("tok_ix") % 5 == 0, "m"), F.lit("n"), F.when(F.col("tok_ix") % 7 == 0, "p"))
    return b.tagged.select("unit_id", "tok_ix", X.gender(feats, F.col("form")).alias("gender"), X.number(feats, F.col("form")).alias("number"))


#: Mentions: all nouns and pronouns.
MENTION = """SELECT grouping, unit_id, concat(unit_id, '_', tok_ix) AS mention_id, pos * 4294967296 + tok_ix AS at, lemma, length(form) % 2 = 0 AS is_name, cpos_tag = 'PRO' AS is_pronoun,
    CASE length(form) % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 'unk' END AS gender, CASE length(form) % 4 WHEN 0 THEN 's' WHEN 1 THEN 'unk' ELSE 'p' END AS number FROM tagged WHERE cpos_tag IN ('N', 'PRO')"""
#: Linked units, either way round.
LINKED = "SELECT parent AS unit_a, child AS unit_b FROM pairs WHERE target <> 4 UNION SELECT child, parent FROM pairs WHERE target <> 4"
MORPH = """CASE WHEN (a.gender <> b.gender AND a.gender <> 'unk' AND b.gender <> 'unk') OR (a.number <> b.number AND a.number <> 'unk' AND b.number <> 'unk') THEN 'False'
         WHEN a.gender = 'unk' OR b.gender = 'unk' OR a.number = 'unk' OR b.number = 'unk' THEN 'unk' ELSE 'True' END"""
MATCH = f"""SELECT a.grouping, a.mention_id AS mention_id_a, b.mention_id AS mention_id_b, a.lemma = b.lemma AS string_match, a.lemma = b.lemma AND a.is_name AND b.is_name AS name_match,
    {MORPH} AS morph_match, b.is_pronoun AS bp FROM ({LINKED}) l JOIN ({MENTION}) a ON a.unit_id = l.unit_a JOIN ({MENTION}) b ON b.unit_id = l.unit_b WHERE a.at < b.at"""
#: Lemmas, and kinds of mentions, of a unit.
UNIT_LEMMAS = f"SELECT DISTINCT unit_id, lemma FROM ({MENTION})"
UNIT_KINDS = f"SELECT DISTINCT pos, id AS unit_id, gender, number, is_pronoun FROM ({MENTION}) m JOIN units u ON u.id = m.unit_id"


def all_mentions(b):
    return b._sql(MENTION, tagged=b.tagged)


@query(f"SELECT grouping, mention_id_a, mention_id_b, string_match, name_match, morph_match, (bp AND morph_match <> 'False') OR string_match AS compatible FROM ({MATCH})")
def x9_mention_pair_match(b):
    out = X.mention_pair_match(all_mentions(b), b.pairs.where("target <> 4").select("grouping", "parent", "child"))
    return out.select("grouping", "mention_id_a", "mention_id_b", "string_match", "name_match", "morph_match", "compatible")


@query(f"""SELECT p.grouping, p.parent, p.child, coalesce(a.n, 0) AS n_parent, coalesce(c.n, 0) AS n_child, s.parent IS NOT NULL AS any_string_match, s.parent IS NOT NULL OR k.parent IS NOT NULL AS any_compatible FROM pairs p
           LEFT JOIN (SELECT unit_id, count(*) AS n FROM ({MENTION}) GROUP BY 1) a ON a.unit_id = p.parent LEFT JOIN (SELECT unit_id, count(*) AS n FROM ({MENTION}) GROUP BY 1) c ON c.unit_id = p.child
           LEFT JOIN (SELECT DISTINCT p.parent, p.child FROM pairs p JOIN ({UNIT_LEMMAS}) a ON a.unit_id = p.parent JOIN ({UNIT_LEMMAS}) b ON b.unit_id = p.child AND b.lemma = a.lemma) s ON s.parent = p.parent AND s.child = p.child
           LEFT JOIN (SELECT DISTINCT p.parent, p.child FROM pairs p JOIN ({UNIT_KINDS}) x ON x.unit_id = p.parent JOIN ({UNIT_KINDS}) y ON y.unit_id = p.child
                      WHERE CASE WHEN p.ppos < p.cpos THEN y.is_pronoun ELSE x.is_pronoun END AND NOT (x.gender <> y.gender AND x.gender <> 'unk' AND y.gender <> 'unk')
                      AND NOT (x.number <> y.number AND x.number <> 'unk' AND y.number <> 'unk')) k ON k.parent = p.parent AND k.child = p.child""")
def x10_anaphora_features(b):
    out = X.anaphora_features(b.pairs.select("grouping", "parent", "child"), all_mentions(b))
    return out.select("grouping", "parent", "child", "n_parent", "n_child", "any_string_match", "any_compatible")


ATTRIBUTES = {"timex": ("False", 2, "'True'"), "timex_signal": ("None", 3, "concat('s', {x} % 5)"), "verb_class": ("unknown", 4, "concat('v', {x})")}
#: A unit has an attribute if its place leaves 1 over; ROOT has none.
SIDES = ", ".join(
    f"CASE WHEN p.{x} > 0 AND p.{x} % {every} = 1 THEN {value.format(x='p.' + x)} ELSE '{default}' END AS {side}_{name}"
    for x, side in (("ppos", "parent"), ("cpos", "child")) for name, (default, every, value) in ATTRIBUTES.items()
)


@query(f"SELECT p.grouping, p.pair_ix, {SIDES} FROM pairs p")
def x11_time_verb_features(b):
    own = b.units.select("grouping", "id", *[F.when(F.col("pos") % every == 1, F.expr(value.format(x="pos"))).alias(name) for name, (_, every, value) in ATTRIBUTES.items()])
    out = X.time_verb_features(b.pairs, own, {name: default for name, (default, *_) in ATTRIBUTES.items()})
    return out.select("grouping", "pair_ix", *[f"{side}_{name}" for side in ("parent", "child") for name in ATTRIBUTES])


@query(f"""SELECT p.grouping, p.pair_ix, coalesce(a.type, c.type) AS relation FROM pairs p LEFT JOIN ({REL}) a ON a.grouping = p.grouping AND a.arg1 = p.parent AND a.arg2 = p.child
           LEFT JOIN ({REL}) c ON c.grouping = p.grouping AND c.arg1 = p.child AND c.arg2 = p.parent""")
def x12_relation_feature(b):
    return X.relation_feature(b.pairs, relations(b), symmetric=True).select("grouping", "pair_ix", "relation")


#: All words of `benchmark`; those that begin with the same two letters are compared.
WORDS = "SELECT DISTINCT lower(w) AS form FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''"
SIMILAR = """SELECT a.form AS word, b.form AS neighbour, 1 / CAST(1 + abs(length(a.form) * 7 - length(b.form) * 5) + ascii(b.form) % 9 AS DOUBLE) AS similarity
    FROM ({g}) a JOIN ({g}) b ON left(a.form, 2) = left(b.form, 2) AND a.form <> b.form"""
RANKED = f"""SELECT word, neighbour, 1 / CAST(row_number() OVER (PARTITION BY word ORDER BY CASE WHEN word = neighbour THEN 0 ELSE 1 END, similarity DESC, neighbour) AS DOUBLE) AS score
    FROM ({SIMILAR.format(g=WORDS)} UNION ALL SELECT DISTINCT word, word, 1.0 FROM ({SIMILAR.format(g=WORDS)}))"""


def similar(b):
    words = b.table("benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").select(F.lower("w").alias("form")).distinct()
    query = SIMILAR.replace("({g})", "words")
    return X.lexical_neighbours(b._sql(query, words=words))


@query(f"SELECT word, neighbour, round(score, 9) AS score FROM ({RANKED})")
def x13_lexical_neighbours(b):
    return similar(b).withColumn("score", F.round("score", 9))


LEMMAS = "SELECT DISTINCT grouping, unit_id, lemma FROM tagged WHERE cpos_tag IN ('N', 'V')"


def side_sql(one: str, two: str, matched: bool) -> str:
    join = "JOIN" if matched else "LEFT JOIN"
    return f"""SELECT grouping, parent, child, avg(coalesce(best, 0)) AS v FROM (SELECT p.grouping, p.parent, p.child, l.lemma FROM pairs p JOIN ({LEMMAS}) l ON l.unit_id = p.{one}) w
        {join} (SELECT p.parent, p.child, a.lemma, max(score) AS best FROM pairs p JOIN ({LEMMAS}) a ON a.unit_id = p.{one} JOIN ({LEMMAS}) c ON c.unit_id = p.{two}
              JOIN ({RANKED}) r ON r.word = a.lemma AND r.neighbour = c.lemma GROUP BY 1, 2, 3) m USING (parent, child, lemma) GROUP BY 1, 2, 3"""


def similarity_sql(matched: bool) -> str:
    return f"""SELECT p.grouping, p.pair_ix, round((coalesce(a.v, 0) + coalesce(c.v, 0)) / 2, 9) AS similarity FROM pairs p
        LEFT JOIN ({side_sql('parent', 'child', matched)}) a ON a.parent = p.parent AND a.child = p.child AND a.grouping = p.grouping
        LEFT JOIN ({side_sql('child', 'parent', matched)}) c ON c.parent = p.parent AND c.child = p.child AND c.grouping = p.grouping"""


def _similarity(b, matched):
    lemmas = b.tagged.where("cpos_tag IN ('N', 'V')").select("grouping", "unit_id", "lemma").distinct()
    out = X.set_similarity(b.pairs, lemmas, similar(b), matched)
    return out.select("grouping", "pair_ix", F.round("similarity", 9).alias("similarity"))


@query(similarity_sql(False))
def x14_set_similarity(b):
    return _similarity(b, False)


@query(similarity_sql(True))
def x15_neighbour_sum(b):
    return _similarity(b, True)


HITS = f"SELECT t.grouping, t.unit_id, g.form, g.major_type, t.tok_start AS start, t.tok_start + length(t.form) AS \"end\" FROM tagged t JOIN ({GAZETTEER}) g ON g.form = t.lemma"


def hits(b):
    return X.gazetteer_tag(b.tagged, gazetteer(b), ["grouping", "unit_id"], longest=2)


@query(HITS)
def x16_gazetteer_tag(b):
    return hits(b)


@query(f"""SELECT u.grouping, u.id AS unit_id, coalesce(h.s, '') AS signals, h.s IS NOT NULL AS has_signal, coalesce(v.c, '') AS verb_class FROM units u
           LEFT JOIN (SELECT unit_id, string_agg(DISTINCT form, ',' ORDER BY form) AS s FROM ({HITS}) WHERE major_type = 't3' GROUP BY 1) h ON h.unit_id = u.id
           LEFT JOIN (SELECT unit_id, string_agg(DISTINCT concat('v', length(lemma)), ',' ORDER BY concat('v', length(lemma))) AS c FROM tagged WHERE cpos_tag = 'V' AND lemma IN (SELECT form FROM ({GAZETTEER})) GROUP BY 1) v ON v.unit_id = u.id""")
def x17_time_tagging(b):
    verbs = gazetteer(b).select(F.col("form").alias("lemma"), F.concat(F.lit("v"), F.length("form")).alias("verb_class"))
    lemmas = b.tagged.where("cpos_tag = 'V'").select("unit_id", "lemma")
    return X.time_tagging(b.units, hits(b).where("major_type = 't3'"), lemmas, verbs)


@query(f"SELECT grouping, unit_id, start, \"end\", form, major_type AS relations, form AS ids FROM ({HITS})")
def x18_marker_tagging(b):
    relations = gazetteer(b).select("form", F.col("major_type").alias("relation"), F.col("form").alias("id"))
    return X.marker_tagging(hits(b), relations, ["grouping", "unit_id"])


#: Hits of two and three words that overlap in many ways, and what a scan of each unit keeps of them.
SCANNED = """WITH RECURSIVE w AS (SELECT grouping, unit_id, tok_ix, tok_start, form, lead(form) OVER u AS f1, lead(form, 2) OVER u AS f2, lead(tok_start + length(form)) OVER u AS e1,
        lead(tok_start + length(form), 2) OVER u AS e2 FROM tagged WINDOW u AS (PARTITION BY unit_id ORDER BY tok_ix)),
    h AS (SELECT grouping, unit_id, tok_start AS start, e1 AS stop, lower(concat(form, ' ', f1)) AS form, 'r2' AS relations FROM w WHERE e1 IS NOT NULL AND (tok_ix * 7 + length(form)) % 3 = 0
          UNION ALL SELECT grouping, unit_id, tok_start, e2, lower(concat(form, ' ', f1, ' ', f2)), 'r3' FROM w WHERE e2 IS NOT NULL AND (tok_ix * 5 + length(form)) % 4 = 0),
    l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY unit_id, start ORDER BY stop DESC) = 1),
    s AS (SELECT unit_id, min(start) AS at FROM l GROUP BY 1
          UNION ALL SELECT s.unit_id, min(n.start) FROM s JOIN l c ON c.unit_id = s.unit_id AND c.start = s.at JOIN l n ON n.unit_id = s.unit_id AND n.start >= c.stop GROUP BY s.unit_id)
    SELECT l.grouping, l.unit_id, l.start, l.stop AS "end", l.form, l.relations, l.form AS ids FROM l JOIN s ON s.unit_id = l.unit_id AND s.at = l.start"""


@query(SCANNED)
def x18_marker_tagging_overlapping(b):
    unit = Window.partitionBy("unit_id").orderBy("tok_ix")
    ends = F.col("tok_start") + F.length("form")
    hits = None
    for more, chosen in ((1, (F.col("tok_ix") * 7 + F.length("form")) % 3 == 0), (2, (F.col("tok_ix") * 5 + F.length("form")) % 4 == 0)):
        form = F.concat_ws(" ", "form", *[F.lead("form", i).over(unit) for i in range(1, more + 1)])
        rows = b.tagged.select("grouping", "unit_id", F.col("tok_start").alias("start"), F.lead(ends, more).over(unit).alias("end"), form.alias("form"), chosen.alias("chosen"))
        rows = rows.where("end IS NOT NULL AND chosen").drop("chosen")
        hits = rows if hits is None else hits.unionByName(rows)
    forms = hits.select("form", F.concat(F.lit("r"), F.size(F.split("form", " "))).alias("relation"), F.lower("form").alias("id")).distinct()
    return X.marker_tagging(hits, forms, ["grouping", "unit_id"])


SECOND = "CASE WHEN ppos <> CASE WHEN cpos = 1 THEN 0 ELSE cpos - 1 - (conv_id + 1 + cpos) % least(cpos - 1, 3) END THEN NULL WHEN ppos = 0 THEN 'altlex' ELSE concat('r', (conv_id + ppos + cpos) % 3, ':x') END"


@query(f"""SELECT grouping, pair_ix, CASE WHEN target = 4 THEN 'discourse' WHEN target = 5 THEN 'discourse' ELSE {NAME.format('target')} END AS first,
           coalesce(CASE WHEN {SECOND} = 'altlex' THEN 'discourse' ELSE split_part({SECOND}, ':', 1) END, 'none') AS second FROM pairs""")
def x19_marker_agreement(b):
    from rhetree.operators.pairs import with_label_names

    first = with_label_names(b.pairs, LABELS).withColumn("label", F.when(F.col("target") == 5, "altlex").when(F.col("target") != 4, F.concat("label", F.lit(":y"))))
    second = b.pairs.withColumn("label", F.expr(SECOND)).where("label IS NOT NULL")
    return X.marker_agreement(first, second, ["grouping", "pair_ix"])


@query("SELECT unit_id, min(tok_start) AS first, count(*) AS n FROM tagged WHERE length(form) > 0 GROUP BY 1")
def x20_token_offsets(b):
    rows = b.units.select("id", "text", F.filter(F.split("text", " "), lambda f: f != "").alias("forms"))
    spans = X.token_offsets(rows).select(F.col("id").alias("unit_id"), F.explode("spans").alias("s")).where("s.start IS NOT NULL")
    return spans.groupBy("unit_id").agg(F.min("s.start").cast("long").alias("first"), F.count(F.lit(1)).alias("n"))


@query("SELECT grouping, parent, child FROM pairs WHERE target <> 4")
def x21_sample_pairs(b):
    links = b.pairs.where("target <> 4")
    return X.sample_pairs(b.units, links, None)


def drawn_sql(n: int, draws: int, seed: int, linked: str, same: bool) -> str:
    """The first n good draws of `draws`, as the library makes them."""
    number = lambda what, below: f"(('0x' || md5(concat('{seed}:', draw, ':{what}'))[1:12])::BIGINT % {below})"
    other = "doc" if same else f"{number(1, '(c - 1)')} + CASE WHEN {number(1, '(c - 1)')} >= doc THEN 1 ELSE 0 END"
    return f"""WITH d AS (SELECT grouping, count(*) AS n, row_number() OVER (ORDER BY md5(grouping), grouping) - 1 AS doc FROM units GROUP BY 1),
        p AS (SELECT grouping, id, row_number() OVER (PARTITION BY grouping ORDER BY span_start, id) - 1 AS place FROM units),
        r AS (SELECT draw, doc, {other} AS doc2 FROM (SELECT draw, c, {number(0, 'c')} AS doc FROM range({draws}) x(draw), (SELECT count(*) AS c FROM d))),
        s AS (SELECT draw, a.grouping, b.grouping AS child_grouping, {number(2, 'a.n')} AS i, {number(3, 'b.n')} AS j FROM r JOIN d a ON a.doc = r.doc JOIN d b ON b.doc = r.doc2),
        u AS (SELECT draw, s.grouping, x.id AS parent, s.child_grouping, y.id AS child,
                     s.grouping = s.child_grouping AND EXISTS (SELECT 1 FROM pairs l WHERE l.target <> 4 AND l.grouping = s.grouping AND ((l.parent = x.id AND l.child = y.id) OR (l.parent = y.id AND l.child = x.id))) AS linked
              FROM s JOIN p x ON x.grouping = s.grouping AND x.place = s.i JOIN p y ON y.grouping = s.child_grouping AND y.place = s.j WHERE x.id <> y.id)
        SELECT * FROM u WHERE {linked} ORDER BY draw LIMIT {n}"""


@query(drawn_sql(300, 20_000, 5, "linked", True))
def x21_sample_linked(b):
    return X.sample_pairs(b.units, b.pairs.where("target <> 4"), 300, seed=5, linked=True)


@query(drawn_sql(300, 20_000, 6, "NOT linked", True))
def x21_sample_unlinked(b):
    return X.sample_pairs(b.units, b.pairs.where("target <> 4"), 300, seed=6, linked=False)


@query(drawn_sql(300, 20_000, 7, "true", False))
def x21_sample_across_documents(b):
    return X.sample_pairs(b.units, b.pairs.where("target <> 4"), 300, seed=7, same_document=False)


@query(f"SELECT type, count(*) AS n FROM ({REL}) WHERE arg1 <> 'ROOT' GROUP BY 1")
def x22_relation_index(b):
    return X.relation_index(relations(b), b.units, simple_only=True).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT t.lemma AS form, g.major_type FROM tagged t JOIN ({GAZETTEER}) g ON g.form = t.lemma WHERE g.major_type = 't3'")
def x23_gazetteer_lookup(b):
    return X.gazetteer_lookup(b.tagged.select(F.col("lemma").alias("form")).distinct(), gazetteer(b), "t3")


@query("SELECT grouping, count(*) AS n_bad FROM tagged WHERE length(form) > 3 GROUP BY 1")
def s18_check_conll(b):
    from rhetree.sources.conll import check_conll

    rows = b.tagged.select("grouping", F.when(F.length("form") > 3, F.array(F.lit("a"))).otherwise(F.array_repeat(F.lit("a"), 10)).alias("cols"))
    return check_conll(rows, ["grouping"]).where("n_bad > 0")
