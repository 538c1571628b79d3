"""Corpus preparation: spans, tokens, mentions, gazetteers, markers, agreement."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import ancestors
from .storage import concluded, large, written

#: Characters of a cell that a range join deals spans into.
CELL = 256
#: Numbers of 64 bits that a document's lemmas are hashed into.
SLOTS = 32


def unit_text(units: DataFrame, texts: DataFrame, key: str = "doc") -> DataFrame:
    """Adds unit_text, the piece of the document's text that a unit spans."""
    piece = F.expr("substring(doc_text, CAST(span_start AS INT) + 1, CAST(span_end - span_start AS INT))")
    return units.join(texts.select(key, F.col("text").alias("doc_text")), key).withColumn("unit_text", piece).drop("doc_text")


def within_units(units: DataFrame, spans: DataFrame, key: str = "grouping", embedded: bool = True, cell: int = CELL) -> DataFrame:
    """Spans (start, end) that a unit contains, with the unit's id as unit_id.

    A span looks only at units that cover its start's cell, so a document's units and
    spans are never all paired. With `embedded` False, a span inside a unit that lies
    strictly within another counts for the inner one only.
    """
    cells = F.sequence(F.floor(F.col("span_start") / cell), F.floor(F.greatest("span_start", F.col("span_end") - 1) / cell))
    dealt = units.select(key, F.col("id").alias("unit_id"), "span_start", "span_end", F.explode(cells).alias("_cell"))
    hits = spans.withColumn("_cell", F.floor(F.col("start") / cell)).join(dealt, [key, "_cell"])
    hits = hits.where((F.col("span_start") <= F.col("start")) & (F.col("end") <= F.col("span_end"))).drop("_cell")
    if embedded:
        return hits
    inner = hits.select(key, "start", "end", F.col("unit_id").alias("_inner"), F.col("span_start").alias("_s"), F.col("span_end").alias("_e")).distinct()
    h, i = hits.alias("h"), inner.alias("i")
    same = [F.col(f"h.{c}") == F.col(f"i.{c}") for c in (key, "start", "end")]
    strict = (F.col("_s") > F.col("h.span_start")) & (F.col("_e") < F.col("h.span_end"))
    return h.join(i, [*same, strict], "left_anti")


def complex_unit_members(complex_units: DataFrame, units: DataFrame) -> DataFrame:
    """(grouping, complex_id, unit columns) of each member."""
    members = complex_units.select("grouping", F.col("id").alias("complex_id"), F.explode("members").alias("id"))
    return members.join(units, ["grouping", "id"])


def token_descents(tokens: DataFrame, sentence: str = "unit_id") -> DataFrame:
    """(sentence, tok_ix, dependent) of all transitive dependents."""
    up = ancestors(tokens.where("head_ix >= 0"), [sentence], "tok_ix", "head_ix")
    return up.select(sentence, F.col("ancestor").alias("tok_ix"), F.col("tok_ix").alias("dependent"))


def token_dependents(tokens: DataFrame, sentence: str = "unit_id") -> DataFrame:
    """n_dependents and yield_length (last less first dependent, 0 if none) of each token."""
    own = token_descents(tokens, sentence).groupBy(sentence, "tok_ix").agg(
        F.count(F.lit(1)).alias("n_dependents"), (F.max("dependent") - F.min("dependent")).alias("yield_length")
    )
    return tokens.select(sentence, "tok_ix").join(large(own), [sentence, "tok_ix"], "left").fillna(0, ["n_dependents", "yield_length"])


def path_to_root(tokens: DataFrame, sentence: str = "unit_id") -> DataFrame:
    """(sentence, tok_ix, path): the categories of the governors up to the root, nearest first."""
    own = tokens.select(sentence, F.col("tok_ix").alias("head_ix"), F.col("cpos_tag").alias("tag"))
    links = tokens.join(large(own), [sentence, "head_ix"], "left_semi")
    up = ancestors(links, [sentence], "tok_ix", "head_ix").withColumnRenamed("ancestor", "head_ix").join(large(own), [sentence, "head_ix"])
    path = F.transform(F.sort_array(F.collect_list(F.struct("dist", "tag"))), lambda x: x["tag"])
    paths = up.groupBy(sentence, "tok_ix").agg(path.alias("path"))
    every = tokens.select(sentence, "tok_ix").distinct().join(large(paths), [sentence, "tok_ix"], "left")
    return every.withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def mentions(tokens: DataFrame, sentence: str = "unit_id") -> DataFrame:
    """Heads of mentions with their extents.

    A head is a noun that no noun governs, or a pronoun that is not relative; the extent
    runs over the head and all it governs.
    """
    gov = tokens.select(sentence, F.col("tok_ix").alias("head_ix"), F.col("cpos_tag").alias("gov_tag"))
    own = tokens.join(large(gov), [sentence, "head_ix"], "left")
    relative = F.coalesce(F.lower("form").isin("qui", "que", "dont", "who", "which"), F.lit(False))
    is_head = ((F.col("cpos_tag") == "N") & ~F.coalesce(F.col("gov_tag") == "N", F.lit(False))) | ((F.col("cpos_tag") == "PRO") & ~relative)
    reach = token_descents(tokens, sentence).groupBy(sentence, "tok_ix").agg(F.min("dependent").alias("lo"), F.max("dependent").alias("hi"))
    out = own.where(is_head).join(large(reach), [sentence, "tok_ix"], "left")
    return out.withColumns({"first_ix": F.least("tok_ix", F.coalesce("lo", "tok_ix")), "last_ix": F.greatest("tok_ix", F.coalesce("hi", "tok_ix"))}).drop("lo", "hi")


#: Patterns of word forms that decide a mention's kind, gender and number.
DEFINITE = r"^(?i)(le|la|les|l'|the)$"
DEMONSTRATIVE = r"^(?i)(ce|cet|cette|ces|this|that|these|those)$"
INDEFINITE = r"^(?i)(un|une|des|a|an|some)$"
POSSESSIVE = r"^(?i)(mon|ma|mes|ton|ta|tes|son|sa|ses|notre|nos|votre|vos|leur|leurs|my|your|his|her|its|our|their)$"
CLITIC = r"^(?i)(je|tu|il|elle|on|nous|vous|ils|elles|me|te|se|lui|en|y|i|he|she|it|we|they)$"
MASCULINE, FEMININE = r"^(?i)(il|ils|lui|he|him)$", r"^(?i)(elle|elles|she|her)$"
PLURAL, SINGULAR = r"^(?i)(ils|elles|nous|vous|les|they|we)$", r"^(?i)(il|elle|je|tu|on|lui|he|she|it|i)$"


def mention_flags(rows: DataFrame, determiner: str = "first_form") -> DataFrame:
    """Twelve booleans on mentions with form (the head's), cpos_tag, `determiner` (the first form) and n_tokens."""
    form, det = F.col("form"), F.col(determiner)
    pronoun, noun = F.col("cpos_tag") == "PRO", F.col("cpos_tag") == "N"
    name = noun & form.rlike(r"^\p{Lu}")
    flags = {
        "is_pronoun": pronoun, "is_clitic": pronoun & form.rlike(CLITIC), "is_strong_pronoun": pronoun & ~form.rlike(CLITIC),
        "is_name": name, "is_short_name": name & (F.col("n_tokens") == 1), "is_long_name": name & (F.col("n_tokens") > 1),
        "is_noun": noun & ~name, "is_definite": noun & det.rlike(DEFINITE), "is_demonstrative": noun & det.rlike(DEMONSTRATIVE),
        "is_indefinite": noun & det.rlike(INDEFINITE), "is_possessive": noun & det.rlike(POSSESSIVE),
        "is_bare": noun & ~det.rlike("|".join((DEFINITE, DEMONSTRATIVE, INDEFINITE, POSSESSIVE))),
    }
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def mention_types(rows: DataFrame, short_name: int = 1, short_np: int = 2) -> DataFrame:
    """The twelve types of mentions that annotated tokens tell, from their head's and their first token's attributes.

    Rows have cpos and pos (the head's coarse and full category), form (the head's),
    first_pos, first_lemma, first_s (the first token's category, lemma and morphological s:
    def or ind) and n_tokens. A null attribute makes no type true.
    """
    first = lambda test: (F.col("first_pos") == "DET") & test
    name, definite, demonstrative = F.col("pos") == "NPP", first(F.col("first_s") == "def"), first(F.col("first_lemma") == "ce")
    types = {
        "is_pro": F.col("cpos").isin("PRO", "CL"), "is_il": F.col("form").isin("Il", "il"), "is_cl_pro": F.col("cpos") == "CL",
        "is_non_refl_cl_pro": F.col("pos").isin("CLS", "CLO"), "is_name": name, "is_short_name": name & (F.col("n_tokens") <= short_name),
        "is_def_np": definite, "is_short_def_np": definite & (F.col("n_tokens") <= short_np), "is_dem_np": demonstrative,
        "is_short_dem_np": demonstrative & (F.col("n_tokens") <= short_np), "is_indef_np": first(F.col("first_s") == "ind"),
        "is_poss_np": first(F.col("first_lemma") == "son"),
    }
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in types.items()})


def gender(feats: Column, form: Column) -> Column:
    """m, f or unk: by morphology, else by the pronoun's form."""
    by_form = F.when(form.rlike(MASCULINE), "m").when(form.rlike(FEMININE), "f")
    return F.coalesce(feats["g"], by_form, F.lit("unk"))


def number(feats: Column, form: Column) -> Column:
    """s, p or unk."""
    by_form = F.when(form.rlike(PLURAL), "p").when(form.rlike(SINGULAR), "s")
    return F.coalesce(feats["n"], by_form, F.lit("unk"))


def _agree(a: Column, b: Column) -> Column:
    return F.when((a == "unk") | (b == "unk"), F.lit("unk")).when(a == b, F.lit("True")).otherwise(F.lit("False"))


def mention_pair_match(rows: DataFrame, links: DataFrame, key: str = "grouping") -> DataFrame:
    """Pairs of mentions of linked units, the first before the second, with what they share.

    Rows have key, unit_id, mention_id, at (place), lemma, is_name, is_pronoun, gender,
    number; links have key, parent, child. Mentions of units that no link joins are not
    paired: the pairs grow with the links, not with the square of a document.
    """
    fields = ["unit_id", "mention_id", "at", "lemma", "is_name", "is_pronoun", "gender", "number"]
    side = lambda x: rows.select(key, *[F.col(c).alias(f"{c}_{x}") for c in fields])
    ends = lambda a, b: links.select(key, F.col(a).alias("unit_id_a"), F.col(b).alias("unit_id_b"))
    linked = ends("parent", "child").unionByName(ends("child", "parent")).distinct()
    both = linked.join(side("a"), [key, "unit_id_a"]).join(side("b"), [key, "unit_id_b"]).where("at_a < at_b")
    same = F.col("lemma_a") == F.col("lemma_b")
    g, n = _agree(F.col("gender_a"), F.col("gender_b")), _agree(F.col("number_a"), F.col("number_b"))
    out = both.withColumns(
        {
            "string_match": same, "name_match": same & F.col("is_name_a") & F.col("is_name_b"),
            "pronoun_match": same & F.col("is_pronoun_a") & F.col("is_pronoun_b"), "gender_match": g, "number_match": n,
        }
    )
    joint = F.when((F.col("gender_match") == "False") | (F.col("number_match") == "False"), "False").when(
        (F.col("gender_match") == "unk") | (F.col("number_match") == "unk"), "unk"
    ).otherwise("True")
    out = out.withColumn("morph_match", joint)
    compatible = (F.col("is_pronoun_b") & (F.col("morph_match") != "False")) | F.col("string_match")
    return out.withColumn("compatible", compatible).select(
        key, "mention_id_a", "mention_id_b", "string_match", "name_match", "pronoun_match", "gender_match", "number_match",
        "morph_match", "compatible",
    )


def anaphora_features(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per unit pair: mentions of each member and whether any two of their mentions match (any, not the last).

    A unit's mentions are summed up first, as its lemmas and its kinds of mentions
    (gender and number), so that mentions are never paired. Units do not overlap: all
    mentions of the earlier one precede those of the other.
    """
    kind = F.struct("gender", "number")
    units = mentions.groupBy("grouping", "unit_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_pronoun").alias("n_pronouns"), F.min("at").alias("at"), F.collect_set("lemma").alias("lemmas"),
        F.collect_set(kind).alias("kinds"), F.collect_set(F.when(F.col("is_pronoun"), kind)).alias("pronouns"),
    )
    names = [c for c in units.columns if c not in ("grouping", "unit_id")]
    side = lambda x: units.select("grouping", F.col("unit_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names])
    out = pairs.join(side("parent"), ["grouping", "parent"], "left").join(side("child"), ["grouping", "child"], "left")
    differ = lambda a, b: (a != b) & (a != "unk") & (b != "unk")
    agree = lambda one, two: F.exists(
        one, lambda a: F.exists(two, lambda b: ~differ(a["gender"], b["gender"]) & ~differ(a["number"], b["number"]))
    )
    by_morphology = F.when(F.col("at_parent") < F.col("at_child"), agree("kinds_parent", "pronouns_child")).otherwise(agree("kinds_child", "pronouns_parent"))
    same = F.coalesce(F.arrays_overlap("lemmas_parent", "lemmas_child"), F.lit(False))
    out = out.withColumns({"any_string_match": same, "any_compatible": same | F.coalesce(by_morphology, F.lit(False))})
    keep = [c for c in out.columns if c not in {f"{n}_{x}" for n in ("at", "lemmas", "kinds", "pronouns") for x in ("parent", "child")}]
    return out.select(*keep).fillna(0, ["n_parent", "n_child", "n_pronouns_parent", "n_pronouns_child"])


def time_verb_features(pairs: DataFrame, attributes: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Copies unit attributes to both members as parent_<name> and child_<name>, with defaults."""
    out = pairs
    for side in ("parent", "child"):
        own = attributes.select("grouping", F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in defaults])
        out = out.join(own, ["grouping", side], "left").fillna({f"{side}_{c}": v for c, v in defaults.items()})
    return out


def relation_feature(pairs: DataFrame, relations: DataFrame, symmetric: bool = False) -> DataFrame:
    """Adds relation, that from parent to child (or, if symmetric, the other way), null if none."""
    one = relations.groupBy("grouping", F.col("arg1").alias("parent"), F.col("arg2").alias("child")).agg(F.min("type").alias("relation"))
    out = pairs.join(one, ["grouping", "parent", "child"], "left")
    if not symmetric:
        return out
    back = one.select("grouping", F.col("parent").alias("child"), F.col("child").alias("parent"), F.col("relation").alias("_back"))
    return out.join(back, ["grouping", "parent", "child"], "left").withColumn("relation", F.coalesce("relation", "_back")).drop("_back")


def lexical_neighbours(similarities: DataFrame) -> DataFrame:
    """(word, neighbour, score): 1 / rank by similarity; every word is its own best neighbour."""
    words = similarities.select("word").distinct()
    rows = similarities.where("word <> neighbour").unionByName(words.select("word", F.col("word").alias("neighbour"), F.lit(1.0).alias("similarity")))
    order = Window.partitionBy("word").orderBy((F.col("word") == F.col("neighbour")).desc(), F.desc("similarity"), "neighbour")
    return rows.select("word", "neighbour", (1 / F.row_number().over(order)).alias("score"))


def neighbour_score(words: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Score of each (word, neighbour), 0 for a pair the table does not have."""
    return words.join(neighbours, ["word", "neighbour"], "left").fillna(0.0, ["score"])


def _near(lemmas: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(grouping, word, neighbour, score) of the words and neighbours that both are lemmas of one document.

    A document's lemmas as SLOTS * 64 hashed bits go with each of its words, so that of a
    word's neighbours hardly any but those that the document has are shuffled; the join
    that follows decides.
    """
    words = lemmas.select("grouping", F.col("lemma").alias("word")).distinct()
    place = F.pmod(F.xxhash64("word"), F.lit(64 * SLOTS))
    hashed = lambda rows: rows.withColumns({"_slot": F.floor(place / 64).cast("int"), "_mask": F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))})
    bits = [F.coalesce(F.bit_or(F.when(F.col("_slot") == i, F.col("_mask"))), F.lit(0).cast("long")) for i in range(SLOTS)]
    sets = hashed(words).groupBy("grouping").agg(F.array(*bits).alias("_bits"))
    other = hashed(neighbours.withColumnsRenamed({"word": "_of", "neighbour": "word"})).withColumnsRenamed({"word": "neighbour", "_of": "word"})
    likely = words.join(sets, "grouping").join(other, "word").where(F.get("_bits", F.col("_slot")).bitwiseAND(F.col("_mask")) != 0)
    return likely.select("grouping", "word", "neighbour", "score").join(words.withColumnRenamed("word", "neighbour"), ["grouping", "neighbour"], "left_semi")


def _best_matches(lemmas: DataFrame, near: DataFrame, one: str, two: str, matched_only: bool) -> DataFrame:
    """(grouping, one, two, from_one): the mean best score of one's lemmas among two's, for units that have any match.

    A lemma's neighbours in its document meet the other units' lemmas by (grouping,
    neighbour): only matches become rows, and what has none counts by number. Both sums
    and the join with the pairs are taken where the matches of a pair have been dealt to.
    """
    own = lemmas.select("grouping", F.col("unit_id").alias(one), F.col("lemma").alias("word"))
    other = lemmas.select("grouping", F.col("unit_id").alias(two), F.col("lemma").alias("neighbour"))
    hits = own.join(near, ["grouping", "word"]).join(other, ["grouping", "neighbour"]).where(F.col(one) != F.col(two))
    hits = hits.select("grouping", "parent", "child", "word", "score").repartition("grouping", "parent", "child")
    best = hits.groupBy("grouping", "parent", "child", "word").agg(F.max("score").alias("score"))
    sums = best.groupBy("grouping", "parent", "child").agg(F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    if not matched_only:
        n = own.groupBy("grouping", one).agg(F.count(F.lit(1)).alias("_words"))
        sums = sums.join(n, ["grouping", one]).withColumn("_n", F.col("_words")).drop("_words")
    return sums.select("grouping", one, two, (F.col("_sum") / F.col("_n")).alias(f"from_{one}"))


def set_similarity(pairs: DataFrame, lemmas: DataFrame, neighbours: DataFrame, matched_only: bool = False) -> DataFrame:
    """Adds similarity: the mean best match of the parent's lemmas in the child's, and the other way, averaged.

    `matched_only` averages over the lemmas that have a match at all (the older form).
    """
    own = written(lemmas.select("grouping", "unit_id", "lemma").distinct(), "lemmas")
    near = concluded(lambda: _near(own, neighbours), "near")
    out = pairs
    for one, two in (("parent", "child"), ("child", "parent")):
        out = out.join(_best_matches(own, near, one, two, matched_only), ["grouping", "parent", "child"], "left")
    total = (F.coalesce("from_parent", F.lit(0.0)) + F.coalesce("from_child", F.lit(0.0))) / 2
    return out.withColumn("similarity", total).drop("from_parent", "from_child")


def gazetteer_tag(tokens: DataFrame, gazetteer: DataFrame, key: list[str], longest: int = 4) -> DataFrame:
    """Whole-word hits of gazetteer forms: key, form, major_type, start, end.

    Forms of up to `longest` words are looked up as the tokens' n-grams; tokens have
    tok_ix, form and tok_start.
    """
    w = Window.partitionBy(*key).orderBy("tok_ix")
    out = None
    for n in range(1, longest + 1):
        words = [F.lead("form", i).over(w) for i in range(n)]
        last = F.lead(F.col("tok_start") + F.length("form"), n - 1).over(w)
        part = tokens.select(*key, F.concat_ws(" ", *words).alias("_form"), F.col("tok_start").alias("start"), last.alias("end"))
        part = part.where("end IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    entries = gazetteer.select(F.lower("form").alias("_form"), "form", "major_type").distinct()
    return out.withColumn("_form", F.lower("_form")).join(entries, "_form").drop("_form")


def time_tagging(units: DataFrame, hits: DataFrame, lemmas: DataFrame, verb_classes: DataFrame) -> DataFrame:
    """Unit attributes from hits (unit_id, form) and lemmas: signals (joined), has_signal, verb_class (joined)."""
    signals = hits.groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_set("form")), ",").alias("signals"))
    verbs = lemmas.join(verb_classes, "lemma").groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_set("verb_class")), ",").alias("verb_class"))
    out = units.select("grouping", F.col("id").alias("unit_id")).join(signals, "unit_id", "left").join(verbs, "unit_id", "left")
    return out.withColumn("has_signal", F.col("signals").isNotNull()).fillna("", ["signals", "verb_class"])


def leftmost_longest(hits: DataFrame, key: list[str]) -> DataFrame:
    """Hits (start, end) that a scan of each text keeps: the longest at the first place, then at the next place at or after its end, and so on.

    One sorted pass: a text's hits stream by in order (of one start the longest first), and a
    hit is kept if it starts at or after the end of the one kept last.
    """
    rest = [c for c in hits.columns if c not in (*key, "start", "end")]
    order = Window.partitionBy(*key).orderBy("start", F.struct("end", *rest).desc())
    first = F.row_number().over(order) == 1
    rows = hits.where("end > start").select("*", first.alias("_first"))
    return rows.mapInArrow(_scanned, rows.schema).drop("_first")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that a scan keeps; those of one text lie together in order, its first one marked."""
    at = 0
    for batch in batches:
        start, end, first = (batch.column(c).to_pylist() for c in ("start", "end", "_first"))
        keep = []
        for s, e, new in zip(start, end, first, strict=True):
            keep.append(new or s >= at)
            if keep[-1]:
                at = e
        yield batch.filter(pa.array(keep, pa.bool_()))


def marker_tagging(hits: DataFrame, relations: DataFrame, key: list[str]) -> DataFrame:
    """Connectives: of the hits those that a leftmost-longest scan keeps; ambiguous forms join their relations and ids."""
    merged = relations.groupBy(F.lower("form").alias("_form")).agg(
        F.array_join(F.sort_array(F.collect_set("relation")), "/").alias("relations"), F.array_join(F.sort_array(F.collect_set("id")), "/").alias("ids")
    )
    own = hits.select(*key, "start", "end", F.lower("form").alias("_form")).distinct()
    return leftmost_longest(own, key).join(merged, "_form").withColumnRenamed("_form", "form")


def marker_agreement(one: DataFrame, two: DataFrame, key: list[str], plain: bool = False) -> DataFrame:
    """(key, first, second) classes of two annotators' labels of the same spans.

    The first is `discourse` where null or `altlex`, else what stands before `:`; the
    second is `none` where it has nothing. `plain` tells only discourse from the rest.
    """
    def kind(c: Column, absent: str) -> Column:
        base = F.when(c.isNull(), F.lit(absent)).when(c == "altlex", F.lit("discourse")).otherwise(F.split(c, ":")[0])
        return F.when(base == "none", base).when(base == "discourse", base).otherwise(F.lit("relation")) if plain else base

    both = one.select(*key, F.col("label").alias("_a")).join(two.select(*key, F.col("label").alias("_b")), key, "left")
    return both.select(*key, kind(F.col("_a"), "discourse").alias("first"), kind(F.col("_b"), "none").alias("second"))


def kappa(agreement: DataFrame) -> DataFrame:
    """One row: n, observed and expected agreement, Cohen's kappa."""
    n = agreement.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("first") == F.col("second"), F.col("n"))), F.lit(0)).alias("same"))
    side = lambda c, x: n.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(x))
    chance = side("first", "a").join(side("second", "b"), "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("chance"))
    out = total.crossJoin(chance)
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return out.select(F.col("total").alias("n"), po.alias("observed"), pe.alias("expected")).withColumn(
        "kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    )


def token_offsets(rows: DataFrame, text: str = "text", forms: str = "forms") -> DataFrame:
    """Adds spans: (form, start, end) of each form in the text, found left to right, whatever its case.

    `_` in a form stands for a space. A form that is not found has null places and does
    not move the cursor.
    """
    low = F.transform(F.col(forms), lambda f: F.lower(F.regexp_replace(f, "_", " ")))
    places = F.arrow_udf(_places, "array<int>")(F.lower(F.col(text)), low, F.transform(F.col(forms), F.length))
    return rows.withColumn("spans", F.zip_with(forms, places, lambda f, at: F.struct(f.alias("form"), at.alias("start"), (at + F.length(f)).alias("end"))))


def _places(texts: pa.Array, forms: pa.Array, sizes: pa.Array) -> pa.Array:
    """Of each text's forms (all in lower case) the places from 0; `sizes` are how far each moves the cursor. The text is lowered once, and searched on from the cursor."""
    out = []
    for text, own, moves in zip(texts.to_pylist(), forms.to_pylist(), sizes.to_pylist(), strict=True):
        at, found = 0, None if own is None else []
        for form, size in zip(own or (), moves or (), strict=True):
            # an empty form stands at the text's head, as for Spark's locate
            place = -1 if text is None or form is None else text.find(form, at) if form else 0
            found.append(place if place >= 0 else None)
            at = place + size if place >= 0 else at
        out.append(found)
    return pa.array(out, pa.list_(pa.int32()))


#: Hex digits of a hash that deal groupings into buckets, in which they are numbered.
BUCKET_DIGITS = 3


def drawn(seed: int, draw: Column, what: int, below: Column) -> Column:
    """A number from 0 to before `below` for a draw, the same for the same seed in any engine with md5."""
    name = F.concat_ws(":", F.lit(seed).cast("string"), draw.cast("string"), F.lit(what).cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long") % below


def _numbered_documents(units: DataFrame) -> DataFrame:
    """(doc, grouping, n): groupings numbered from 0 in the order of their md5, with their number of units."""
    docs = units.groupBy("grouping").agg(F.count(F.lit(1)).alias("n")).withColumn("_h", F.md5(F.col("grouping").cast("binary")))
    docs = docs.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** BUCKET_DIGITS rows at most
    sizes = docs.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "grouping")) - 1
    return docs.join(F.broadcast(sizes), "_b").select((F.col("_first") + place).cast("long").alias("doc"), "grouping", "n")


def sample_pairs(units: DataFrame, links: DataFrame, n: int | None, seed: int = 0, linked: bool | None = None, same_document: bool = True) -> DataFrame:
    """All linked pairs if n is None; else (draw, grouping, parent, child_grouping, child, linked) of n pairs drawn with replacement.

    A draw takes a document, then a unit of it, then another unit of it, or one of another
    document (`same_document` False, where nothing is linked). Draws have numbers and are
    looked up by joins: document number, then (document, unit number); no two units are
    paired that were not drawn together. The first n draws stay that are not of one unit
    twice and, if asked for, are linked (True, in either direction) or not (False); draws
    are made in rounds, as many as the share of good ones asks for.
    """
    if n is None:
        return links.select("grouping", "parent", "child")
    return concluded(lambda: _sample_pairs(units, links, n, seed, linked, same_document), "sample")


def _sample_pairs(units: DataFrame, links: DataFrame, n: int, seed: int, linked: bool | None, same_document: bool) -> DataFrame:
    spark = units.sparkSession
    docs = written(_numbered_documents(units), "documents")
    at = F.row_number().over(Window.partitionBy("grouping").orderBy("span_start", "id")) - 1
    places = written(units.select("grouping", "id", at.cast("long").alias("place")), "places")
    ways = written(links.select("grouping", F.least("parent", "child").alias("_low"), F.greatest("parent", "child").alias("_high")).distinct(), "links")
    n_docs = docs.count()
    if n_docs < (1 if same_document else 2):
        raise ValueError("there are no documents to draw from")
    found, made, kept = None, 0, 0
    size = max(1000, 2 * n)
    while kept < n:
        draw = F.col("draw")
        rows = spark.range(made, made + size).withColumnRenamed("id", "draw").withColumn("doc", drawn(seed, draw, 0, F.lit(n_docs)))
        rows = rows.join(docs, "doc")
        if same_document:
            rows = rows.withColumns({"child_grouping": F.col("grouping"), "_n": F.col("n")})
        else:
            other = drawn(seed, draw, 1, F.lit(n_docs - 1))
            rows = rows.withColumn("doc", other + (other >= F.col("doc")).cast("long"))
            rows = rows.join(docs.select("doc", F.col("grouping").alias("child_grouping"), F.col("n").alias("_n")), "doc")
        rows = rows.select("draw", "grouping", "child_grouping", drawn(seed, draw, 2, F.col("n")).alias("_a"), drawn(seed, draw, 3, F.col("_n")).alias("_b"))
        one, two = (places.select(F.col("grouping").alias(g), F.col("place").alias(p), F.col("id").alias(u)) for g, p, u in (("grouping", "_a", "parent"), ("child_grouping", "_b", "child")))
        rows = rows.join(one, ["grouping", "_a"]).join(two, ["child_grouping", "_b"]).where("grouping <> child_grouping OR parent <> child")
        rows = rows.withColumns({"_low": F.least("parent", "child"), "_high": F.greatest("parent", "child")})
        rows = rows.join(ways.withColumn("linked", F.col("grouping") == F.col("grouping")), ["grouping", "_low", "_high"], "left")
        rows = rows.withColumn("linked", F.coalesce("linked", F.lit(False)) & (F.col("grouping") == F.col("child_grouping")))
        if linked is not None:
            rows = rows.where(F.col("linked") == linked)
        rows = written(rows.select("draw", "grouping", "parent", "child_grouping", "child", "linked"), "drawn")
        found = rows if found is None else found.unionByName(rows)
        made, kept = made + size, kept + rows.count()
        if not kept and made > 1_000_000:
            raise ValueError("no draw gives such a pair")
        size = int(min(10_000_000, max(1000, 1.2 * (n - kept) * made / max(kept, 0.1))))
    return found.orderBy("draw").limit(n)


def relation_index(relations: DataFrame, units: DataFrame, simple_only: bool = False) -> DataFrame:
    """Relations by type; `simple_only`: those between units, not complex ones."""
    if simple_only:
        for arg in ("arg1", "arg2"):
            ids = units.select("grouping", F.col("id").alias(arg))
            relations = relations.join(ids, ["grouping", arg], "left_semi")
    return relations.select("type", "grouping", "arg1", "arg2")


def gazetteer_lookup(forms: DataFrame, gazetteer: DataFrame, major_type: str | None = None) -> DataFrame:
    """All entries of each form, over all types or of one."""
    entries = gazetteer if major_type is None else gazetteer.where(F.col("major_type") == major_type)
    return forms.join(entries, "form")


def gazetteer_index(gazetteer: DataFrame) -> DataFrame:
    """(form, types): a map from the types of a form to its entries."""
    one = gazetteer.groupBy("form", "major_type").agg(F.max(F.struct("minor_type", "val")).alias("entry"))
    return one.groupBy("form").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("major_type", "entry")))).alias("types"))
