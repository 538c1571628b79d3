"""Queries of the file sources: a bridge table is written in a source's format, and read back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetree.operators.storage import concluded, new_table
from rhetree.sources import conll, files

from .bridge import LABELS
from .registry import query

ORDER = ["grouping", "pair_ix"]
#: Pairs with their numbers in the order of the files.
LINES = "(SELECT *, row_number() OVER (ORDER BY grouping, pair_ix) - 1 AS line FROM pairs)"


def stored(rows: DataFrame, *order: str) -> str:
    """A folder of text files with the column `value`, in order over all files."""
    path = new_table(rows.sparkSession, "text-files")
    rows.orderBy(*order).select("value").write.text(path)
    return path


def tabbed(rows: DataFrame) -> str:
    path = new_table(rows.sparkSession, "tab-files")
    rows.write.option("sep", "\t").option("quoteAll", True).option("escape", '"').csv(path)
    return path


def lines(b, *columns: str) -> DataFrame:
    return b.pairs.select(*ORDER, F.concat_ws("\t", *columns).alias("value"))


def features(b, header: bool = True) -> DataFrame:
    """Feature lines under their list of labels; numbers from 1."""
    rows = b.pairs.select(
        *ORDER, F.concat_ws(" ", "target", F.concat(F.lit("1:"), F.abs(F.col("cpos") - F.col("ppos"))), F.when(F.col("cpos") > F.col("ppos"), "3:1")).alias("value")
    )
    head = b.spark.createDataFrame([("", -1, f"# labels: {' '.join(LABELS[1:])}")], "grouping string, pair_ix long, value string")
    return rows.unionByName(head)


def vocabulary(b) -> DataFrame:
    return b.spark.range(3).select("id", F.concat(F.lit("f"), "id", F.lit("\t"), F.col("id") + 1).alias("value"))


@query("SELECT id, text, grouping, subgrouping, span_start::INTEGER AS span_start, span_end::INTEGER AS span_end FROM units")
def s1_read_units(b):
    return concluded(lambda: files.read_units(b.spark, tabbed(b.units.select(*files.UNIT_COLUMNS))), "units")


@query(f"SELECT line AS pair_ix, parent, child FROM {LINES}")
def s2_read_pairs(b):
    return concluded(lambda: files.read_pairs(b.spark, stored(lines(b, "parent", "child", "grouping"), *ORDER)), "pairs")


@query("SELECT unnest(range(0, 6)) AS ix, unnest(['__UNK__', 'elaboration', 'narration', 'continuation', 'UNRELATED', 'ROOT']) AS name FROM (SELECT 1 FROM pairs LIMIT 1)")
def s3_read_label_list(b):
    out = []

    def run():
        out.extend(files.read_label_list(b.spark, stored(features(b), *ORDER)))
        return b.spark.createDataFrame(list(enumerate(out)), "ix long, name string")

    return concluded(run, "labels")


@query(f"SELECT line AS pair_ix, target, abs(cpos - ppos)::DOUBLE AS f0, 0::DOUBLE AS f1, CASE WHEN cpos > ppos THEN 1 ELSE 0 END::DOUBLE AS f2 FROM {LINES}")
def s4_read_features(b):
    rows = concluded(lambda: files.read_features(b.spark, stored(features(b), *ORDER), 3), "features")
    dense = vector_to_array("features")
    return rows.select("pair_ix", "target", *[F.get(dense, F.lit(i)).alias(f"f{i}") for i in range(3)])


@query(f"""SELECT line AS pair_ix, target, 0::BIGINT AS ix, abs(cpos - ppos)::DOUBLE AS value FROM {LINES} UNION ALL SELECT line, target, 2, 1 FROM {LINES} WHERE cpos > ppos""")
def s4_read_feature_items(b):
    rows = concluded(lambda: files.read_feature_items(b.spark, stored(features(b), *ORDER)), "items")
    return rows.select("pair_ix", "target", F.explode("items").alias("x")).select("pair_ix", "target", "x.*")


@query("""SELECT (row_number() OVER (ORDER BY w) - 1)::INTEGER AS feature_ix, w AS name FROM (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '' AND NOT contains(w, chr(10)))""")
def s5_read_vocab(b):
    words = b.table("benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> '' AND NOT contains(w, chr(10))").distinct()
    return concluded(lambda: files.read_vocab(b.spark, stored(words.select("w", F.concat("w", F.lit("\tx")).alias("value")), "w")), "vocab")


@query(f"SELECT grouping, line AS pair_ix, parent, child, psub, csub, target, abs(cpos - ppos)::DOUBLE AS f0 FROM {LINES}")
def s7_j1_load_corpus(b):
    def run():
        _, pairs, _ = files.load_corpus(b.spark, tabbed(b.units.select(*files.UNIT_COLUMNS)), stored(lines(b, "parent", "child"), *ORDER), stored(features(b), *ORDER), stored(vocabulary(b), "id"))
        return pairs.select("grouping", "pair_ix", "parent", "child", "psub", "csub", "target", F.get(vector_to_array("features"), F.lit(0)).alias("f0"))

    return concluded(run, "corpus")


@query("SELECT parent, child, CASE WHEN target = 4 THEN 'UNRELATED' ELSE 'linked' END AS label FROM pairs")
def s8_s9_predictions(b):
    def run():
        path = new_table(b.spark, "predictions")
        files.write_predictions(b.pairs.withColumn("label", F.when(F.col("target") == 4, "UNRELATED").otherwise("linked")), path)
        return files.read_predictions(b.spark, path)

    return concluded(run, "read-predictions")


@query("SELECT DISTINCT grouping, (conv_id % 3)::INTEGER AS fold FROM units")
def s11_folds(b):
    def run():
        path = new_table(b.spark, "folds")
        files.write_folds(b.units.select("grouping", (F.col("conv_id") % 3).cast("int").alias("fold")).distinct(), path)
        return files.read_folds(b.spark, path)

    return concluded(run, "read-folds")


@query(f"""SELECT line AS instance_id, 'C#distance' AS name, abs(cpos - ppos)::VARCHAR AS value FROM {LINES} UNION ALL SELECT line, 'c#class', CASE WHEN target <> 4 THEN 'True' ELSE 'False' END FROM {LINES}""")
def s12_read_feature_maps(b):
    def run():
        item = F.concat_ws(" ", F.concat(F.lit("C#distance="), F.abs(F.col("cpos") - F.col("ppos"))), F.concat(F.lit("c#class="), F.when(F.col("target") != 4, "True").otherwise("False")))
        return files.read_feature_maps(b.spark, stored(b.pairs.select(*ORDER, item.alias("value")), *ORDER))

    return concluded(run, "maps").select("instance_id", F.explode("feats").alias("name", "value"))


@query("SELECT unit_id, count(*) AS n_tokens, count(DISTINCT form) AS n_forms FROM tagged WHERE form <> '' AND NOT regexp_matches(form, '\\s') GROUP BY 1")
def s17_read_conll(b):
    def run():
        token = F.concat_ws("\t", "unit_id", "form", *[F.lit("_")] * 8)
        some = b.tagged.where("form <> '' AND NOT form RLIKE '\\\\s'")
        text = some.groupBy("grouping", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_ix", token.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
        rows = conll.read_conll(b.spark, stored(text.select("unit_id", F.concat("value", F.lit("\n")).alias("value")), "unit_id"))
        return rows.select(F.get("cols", F.lit(0)).alias("unit_id"), F.get("cols", F.lit(1)).alias("form"))

    return concluded(run, "conll").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("form").alias("n_forms"))


@query("""SELECT DISTINCT w AS form, concat('t', length(w) % 3) AS minor_type, length(w)::VARCHAR AS val FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)
          WHERE w <> '' AND NOT contains(w, ':') AND NOT contains(w, chr(10)) AND left(w, 1) NOT IN ('%', '/', '#')""")
def s19_read_gazetteer(b):
    words = b.table("benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> '' AND NOT contains(w, ':') AND NOT contains(w, chr(10))").distinct()
    line = F.concat("w", F.lit(":type=t"), F.length("w") % 3, F.lit(":val="), F.length("w"))
    out = concluded(lambda: files.read_gazetteer(b.spark, stored(words.select("w", line.alias("value")), "w")), "gazetteer")
    return out.select("form", "minor_type", "val").distinct()
