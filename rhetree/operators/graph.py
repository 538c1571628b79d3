"""Comparing and drawing graphs of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetree.functions.columns import UNRELATED

LINK = ["grouping", "parent", "child"]


def select_links(links: DataFrame, hide: str | None = None, units: DataFrame | None = None) -> DataFrame:
    """Links (with psub, csub), those that touch `units` if given.

    hide="inter": only links within a subgrouping. hide="intra": links between
    subgroupings, members being the subgroupings; links of a subgrouping with itself go.
    """
    if units is not None:
        ids = units.select("grouping", F.col("id").alias("_id")).distinct()
        touched = links.select(*LINK, F.explode(F.array("parent", "child")).alias("_id")).join(ids, ["grouping", "_id"], "left_semi")
        links = links.join(touched, LINK, "left_semi")
    if hide == "inter":
        return links.where(F.col("psub") == F.col("csub"))
    if hide == "intra":
        lifted = links.withColumns({"parent": F.coalesce("psub", "parent"), "child": F.coalesce("csub", "child")})
        return lifted.where("parent <> child").drop("psub", "csub").distinct()
    return links


def diff_links(source: DataFrame, target: DataFrame) -> DataFrame:
    """Links of two graphs (with label): status both, source, target or neither, and the label `a` or `a | b`.

    Rows whose label is UNRELATED are no links; a pair that neither side links is `neither`.
    """
    a = source.select(*LINK, F.nullif(F.col("label"), F.lit(UNRELATED)).alias("a")).groupBy(*LINK).agg(F.max("a").alias("a"))
    b = target.select(*LINK, F.nullif(F.col("label"), F.lit(UNRELATED)).alias("b")).groupBy(*LINK).agg(F.max("b").alias("b"))
    both = a.join(b, LINK, "full")
    la, lb = F.col("a"), F.col("b")
    status = F.when(la.isNotNull() & lb.isNotNull(), "both").when(la.isNotNull(), "source").when(lb.isNotNull(), "target").otherwise("neither")
    label = F.when(la != lb, F.concat_ws(" | ", la, lb)).otherwise(F.coalesce(la, lb, F.lit(UNRELATED)))
    return both.select(*LINK, status.alias("status"), label.alias("label"))


def dot_text(units: DataFrame, links: DataFrame, within: bool = False) -> DataFrame:
    """(grouping, dot): a graph description per grouping that has links.

    Units are nodes in a cluster for each subgrouping. Links have label and may have
    status: source links are dashed, target links dotted, common ones plain.
    """
    status = F.col("status") if "status" in links.columns else F.lit("both")
    links = links.withColumn("status", status)
    if within:
        links = links.where(F.col("psub") == F.col("csub"))
    style = F.create_map(*[F.lit(x) for x in ("both", "solid", "source", "dashed", "target", "dotted")])
    edge = F.format_string('  "%s" -> "%s" [label="%s", style=%s];', "parent", "child", "label", style[F.col("status")])
    edges = links.where(F.col("label") != UNRELATED).groupBy("grouping").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    text = F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), '"', r'\\"')
    text = F.regexp_replace(text, "\n", " ")
    node = F.format_string('    "%s" [label="%s"];', "id", text)
    named = units.join(edges, "grouping", "left_semi").groupBy("grouping", "subgrouping").agg(
        F.sort_array(F.collect_list(F.struct("span_start", node.alias("n")))).alias("nodes")
    )
    cluster = F.concat(
        F.format_string('  subgraph "cluster_%s" {\n', "subgrouping"), F.array_join(F.transform("nodes", lambda x: x["n"]), "\n"), F.lit("\n  }")
    )
    clusters = named.groupBy("grouping").agg(F.sort_array(F.collect_list(F.struct("nodes", cluster.alias("c")))).alias("clusters"))
    body = F.concat(
        F.format_string('digraph "%s" {\n', "grouping"), F.array_join(F.transform("clusters", lambda x: x["c"]), "\n"),
        F.lit("\n"), F.array_join("edges", "\n"), F.lit("\n}"),
    )
    return edges.join(clusters, "grouping").select("grouping", body.alias("dot"))
