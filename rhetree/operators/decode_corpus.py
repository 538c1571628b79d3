"""Search decoders over a whole corpus: every document's graph in one job, as rounds over tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhetree.functions.columns import ROOT, best_label, name_of

from .decode import neighbours
from .features import COORDINATING, SCHEMES
from .greedy import greedy_links
from .projective import projective_tree
from .reading_order import reading_order_trees
from .storage import concluded, large, written
from .trees import first_of_each, odds, spanning_dag, spanning_tree, with_root

DECODERS = ("mst", "msdag", "eisner", "greedy", "reading_order")


def with_coordinating(weights: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Adds `coordinating`: whether a pair's best label, by its place in `labels`, or its class coordinates; all others subordinate."""
    classes = SCHEMES["minsdrt"]
    names = {*COORDINATING, *(name for kind in COORDINATING for name in classes[kind])}
    return weights.withColumn("coordinating", name_of(best_label(F.col("label_w")), labels).isin(*sorted(names)))


def logs(attach: Column, use_prob: bool = True) -> list[Column]:
    """(high, low) of a link's score: the logarithm of a probability, or the raw score; impossible links count -1 in the high part."""
    p = attach.cast("double")
    if not use_prob:
        return [F.lit(0).cast("long").alias("high"), p.alias("low")]
    return [F.when(p > 0, 0).otherwise(-1).cast("long").alias("high"), F.when(p > 0, F.ln(p)).otherwise(0.0).alias("low")]


def numbered(links: DataFrame, units: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Links with p and c, and (key, id, pos, span_start, span_end): units' places in reading order from 0, ROOT first."""
    own = list(key)
    ends = links.select(*own, F.explode(F.array("parent", "child")).alias("id")).distinct()
    spans = ends.join(large(units.select("grouping", "id", "span_start", "span_end")), ["grouping", "id"], "left").fillna(-1, ["span_start", "span_end"])
    at = Window.partitionBy(*own).orderBy(F.col("id") != ROOT, "span_start", "span_end", "id")
    placed = written(spans.withColumn("pos", (F.row_number().over(at) - 1).cast("int")), "places")
    place = lambda c, x: placed.select(*own, F.col("id").alias(c), F.col("pos").alias(x))
    return links.join(large(place("parent", "p")), [*own, "parent"]).join(large(place("child", "c")), [*own, "child"]), placed


def chosen_links(
    weights: DataFrame, units: DataFrame, decoder: str, use_prob: bool = True, key: Sequence[str] = ("grouping",), root: str = "fake", **options,
) -> DataFrame:
    """(key, k, pair_ix) of the links that a decoder takes; k is 1 but for n-best decoding."""
    own = list(key)
    extra = [c for c in ("coordinating",) if c in weights.columns]
    slim = first_of_each(weights.select(*own, F.col("pair_ix").cast("long"), "parent", "child", F.col("attach").cast("double").alias("attach"), *extra).where("attach IS NOT NULL"), own)
    one = lambda rows: rows.select(*own, F.lit(1).alias("k"), "pair_ix")
    if decoder in ("mst", "msdag"):
        links = with_root(slim, units, own, root).select("*", *odds(F.col("attach"), use_prob))
        return one((spanning_tree if decoder == "mst" else spanning_dag)(links, own))
    if decoder not in DECODERS:
        raise ValueError(f"unknown decoder {decoder}")
    # written, since places and numbers both read it: what the weights come from is worked out once
    links, places = numbered(written(slim, "candidates"), units, own)
    if decoder == "greedy":
        ends = places.select(*own, "id", "span_start", "span_end")
        near = neighbours(ends, own)
        place = lambda c, x: places.select(*own, F.col("id").alias(c), F.col("pos").alias(x))
        near = near.join(large(place("one", "p")), [*own, "one"]).join(large(place("two", "c")), [*own, "two"])
        return one(greedy_links(links, near, places.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), own))
    links = links.where("p <> c").select("*", *logs(F.col("attach"), use_prob))
    if decoder == "eisner":
        return one(projective_tree(links.where("c > 0"), own, **options))
    return reading_order_trees(links, own, **options)


def decode_corpus(
    weights: DataFrame, units: DataFrame, decoder: str | Callable[[DataFrame], DataFrame], unrelated: int, use_prob: bool = True,
    key: Sequence[str] = ("grouping",), **options,
) -> DataFrame:
    """Weights with the `prediction` of one of DECODERS, or of any function of the weights that gives (grouping, pair_ix) of its links.

    Every decoder works on all documents at once, or on all parts where `key` names more
    columns; `options` are those of the decoder (root, one_root, heuristic, frontier, beam).
    The full frontier reads the boolean column `coordinating` (`with_coordinating`). For
    n-best ways see `decode_nbest`.
    """
    if options.get("nbest", 1) != 1:
        raise ValueError("use decode_nbest")
    run = decoder if callable(decoder) else lambda rows: chosen_links(rows, units, decoder, use_prob, key, **options)
    links = concluded(lambda: run(weights).select("grouping", "pair_ix"), "links").distinct()
    return _marked(weights, links, unrelated)


def _marked(weights: DataFrame, links: DataFrame, unrelated: int) -> DataFrame:
    marked = weights.join(large(links.withColumn("_link", F.lit(True))), ["grouping", "pair_ix"], "left")
    label = best_label(F.col("label_w")) if "label_w" in weights.columns else F.lit(0)
    return marked.withColumn("prediction", F.when(F.col("_link"), label).otherwise(F.lit(unrelated))).drop("_link")


def decode_nbest(weights: DataFrame, units: DataFrame, unrelated: int, nbest: int, use_prob: bool = True, key: Sequence[str] = ("grouping",), **options) -> DataFrame:
    """The weights once for each of a document's n best ways in reading order: `k` from 1, and `prediction`."""
    links = concluded(lambda: chosen_links(weights, units, "reading_order", use_prob, key, nbest=nbest, **options), "nbest")
    ways = links.select("grouping", "k").distinct()
    every = weights.join(ways, "grouping")
    marked = every.join(links.select("grouping", "k", "pair_ix").distinct().withColumn("_link", F.lit(True)), ["grouping", "k", "pair_ix"], "left")
    label = best_label(F.col("label_w")) if "label_w" in weights.columns else F.lit(0)
    return marked.withColumn("prediction", F.when(F.col("_link"), label).otherwise(F.lit(unrelated))).drop("_link")
