"""The corpus files: units, pairs, features, labels, predictions, folds, feature maps, gazetteers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rhetree.functions.columns import ROOT
from rhetree.operators.pairs import link_units, unknown_ids, validate_corpus

UNIT_COLUMNS = ("id", "text", "grouping", "subgrouping", "span_start", "span_end")


def numbered(scan: DataFrame, keep: Column | None = None, number: str = "line_no") -> DataFrame:
    """Rows of a file scan (all columns) with their place, from 0, by file name and place in the file.

    A scan reads a file block by block and a block's rows in order. Rows that `keep` lets
    pass are counted per block, the counts of the blocks before are summed up, and a row
    adds its place in its own block: no row moves for its number, and what is ordered as
    a whole are the blocks. The numbers hold as long as the files do.
    """
    own = scan.columns
    at = ["_file", "_block"]
    rows = scan.select(*own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    rows = (rows if keep is None else rows.where(keep)).withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.groupBy(*at).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_n"))
    files = files.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ahead = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).join(files, "_file")
    place = F.col("_before") + F.col("_ahead") + F.col("_id") - F.col("_first")
    return rows.join(blocks.drop("_n"), at).select(place.cast("long").alias(number), *own)


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line_no, value): lines of a text file or folder, those that `keep` lets pass numbered from 0 in file order."""
    return numbered(spark.read.text(path), keep)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated units of six columns; quotes double inside quotes, blank lines are skipped.

    Raises if a row has another number of columns or a span that is no number.
    """
    schema = ", ".join(f"{c} string" for c in (*UNIT_COLUMNS, "_more"))
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    spans = [F.col(c).try_cast("int") for c in ("span_start", "span_end")]
    bad = rows.where(F.col("_more").isNotNull() | spans[0].isNull() | spans[1].isNull())
    if (first := bad.first()) is not None:
        raise ValueError(f"malformed unit: {tuple(first)}"[:1000])
    return rows.select(*UNIT_COLUMNS[:4], spans[0].alias("span_start"), spans[1].alias("span_end"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_ix, parent, child) from lines of two or three columns; the third is left out."""
    rows = numbered_lines(spark, path, F.trim("value") != "").withColumn("c", F.split("value", "\t"))
    return rows.select(F.col("line_no").alias("pair_ix"), F.col("c")[0].alias("parent"), F.col("c")[1].alias("child"))


def read_label_list(spark: SparkSession, path: str) -> list[str]:
    """__UNK__ and the labels of the first line `# labels: ...`."""
    first = numbered_lines(spark, path).where("line_no = 0").select("value").first()
    line = first[0] if first else ""
    mark = "# labels:"
    return ["__UNK__", *(line[len(mark):].split() if line.startswith(mark) else [])]


def read_features(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(pair_ix, target, features) from lines `label index:value ...`, indices from 1 up to n; features are sparse vectors.

    Lines that begin with # are left out before numbering, so that numbers are those of
    the pairs; a line may hold a label alone.
    """
    rows = numbered(spark.read.format("libsvm").option("numFeatures", str(n)).load(path), number="pair_ix")
    return rows.select("pair_ix", F.col("label").cast("int").alias("target"), "features")


def read_feature_items(spark: SparkSession, path: str) -> DataFrame:
    """(pair_ix, target, items): the same with features as an array of (ix from 0, value), of no width, for learners over tables."""
    keep = ~F.col("value").startswith("#") & (F.trim("value") != "")
    parts = numbered_lines(spark, path, keep).withColumn("p", F.split(F.trim("value"), r"\s+"))
    pair = lambda x: F.struct((F.split(x, ":")[0].cast("long") - 1).alias("ix"), F.split(x, ":")[1].cast("double").alias("value"))
    items = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), pair)
    return parts.select(F.col("line_no").alias("pair_ix"), F.col("p")[0].cast("double").cast("int").alias("target"), items.alias("items"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(feature_ix, name): the first column of each line."""
    rows = numbered_lines(spark, path, F.col("value") != "")
    return rows.select(F.col("line_no").cast("int").alias("feature_ix"), F.split("value", "\t")[0].alias("name"))


def load_corpus(spark: SparkSession, units: str, pairs: str, features: str, vocab: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(units, pairs with features and targets, labels), validated; a pair's grouping is that of its child.

    Raises if a pair names an unknown unit, or if features and pairs differ in number.
    """
    u, p, labels = read_units(spark, units), read_pairs(spark, pairs), read_label_list(spark, features)
    if (bad := unknown_ids(u, p).limit(50).collect()):
        raise ValueError(f"unknown units: {sorted(r[0] for r in bad)}"[:1000])
    f = read_features(spark, features, read_vocab(spark, vocab).count())
    both = p.join(f, "pair_ix", "full")
    if not both.where("parent IS NULL OR target IS NULL").isEmpty():
        raise ValueError("features and pairs do not align")
    linked = link_units(u, both).withColumnRenamed("c_grouping", "grouping")
    linked = linked.select("grouping", "pair_ix", "parent", "child", "psub", "csub", "target", "features")
    validate_corpus(u, linked, labels, strict=True)
    return u, linked.repartition("grouping"), labels


def write_predictions(rows: DataFrame, path: str) -> None:
    """Tab-separated parent, child, label in pair order within files."""
    rows.sortWithinPartitions("grouping", "pair_ix").select("parent", "child", "label").write.option("sep", "\t").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, label); further columns are left out."""
    rows = spark.read.option("sep", "\t").schema("parent string, child string, label string, more string").csv(path)
    return rows.select("parent", "child", "label")


def write_folds(folds: DataFrame, path: str) -> None:
    """One JSON object from groupings to folds: as the format is a single object, all groupings pass through one row."""
    entries = F.sort_array(F.collect_list(F.struct("grouping", "fold")))
    folds.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.text(path)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(grouping, fold) from one JSON object."""
    rows = spark.read.text(path, wholetext=True).where("trim(value) <> ''")
    return rows.select(F.explode(F.from_json("value", "map<string,int>")).alias("grouping", "fold"))


def read_feature_maps(spark: SparkSession, path: str, item: str = r"\s+", equals: str = "=", restore: str | None = None) -> DataFrame:
    """(instance_id, feats): lines of name=value items, of all files of a folder.

    `restore` is a feature name that the eighth item of a line has lost and gets back.
    """
    parts = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("p", F.split(F.trim("value"), item))
    if restore:
        whole = F.when(F.get("p", F.lit(7)).contains(equals), F.get("p", F.lit(7))).otherwise(F.concat(F.lit(restore + equals), F.get("p", F.lit(7))))
        parts = parts.withColumn("p", F.when(F.size("p") > 7, F.concat(F.slice("p", 1, 7), F.array(whole), F.slice("p", F.lit(9), F.size("p")))).otherwise(F.col("p")))
    pair = lambda x: F.struct(F.split(x, equals, 2)[0].alias("k"), F.split(x, equals, 2)[1].alias("v"))
    kept = F.filter("p", lambda x: x.contains(equals))
    return parts.select(F.col("line_no").alias("instance_id"), F.map_from_entries(F.array_distinct(F.transform(kept, pair))).alias("feats"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(major_type, form, minor_type, val) from lines `form:type=..:val=..`.

    Lines that begin with %, / or # are comments; the type is the file's stem; of equal
    forms of a type the last stays.
    """
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.where((F.trim("value") != "") & ~F.substring("value", 1, 1).isin("%", "/", "#"))
    parts = F.split("value", ":", 2)
    feats = F.when(F.size(parts) > 1, F.str_to_map(parts[1], F.lit(":"), F.lit("=")))
    own = rows.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("major_type"), parts[0].alias("form"), feats.alias("f"), "at")
    last = own.groupBy("major_type", "form").agg(F.max_by("f", "at").alias("f"))
    return last.select("major_type", "form", F.col("f")["type"].alias("minor_type"), F.col("f")["val"].alias("val"))


def with_root(units: DataFrame) -> DataFrame:
    """The units and a ROOT row per grouping: span (0, 0), empty text, no subgrouping."""
    root = units.select("grouping").distinct().select(
        F.lit(ROOT).alias("id"), F.lit("").alias("text"), "grouping", F.lit(None).cast("string").alias("subgrouping"),
        F.lit(0).alias("span_start"), F.lit(0).alias("span_end"),
    )
    return units.select(*UNIT_COLUMNS).unionByName(root)
