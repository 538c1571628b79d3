"""Annotation files in XML: native, stand-off, and parsed tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
    return rows.withColumn("doc", stem(F.col("_metadata.file_path")))


def stem(path: Column) -> Column:
    """A file's name without folder and endings."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^/]*)?$", 1)


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """units, complex_units (with members), relations and texts of native files."""
    units = _rows(spark, path, "EDU", "_id string, _start int, _end int, _VALUE string")
    complex_units = _rows(spark, path, "CS", "_id string, member array<string>")
    relations = _rows(spark, path, "rel", "`from` string, `to` string, `type` string")
    texts = _rows(spark, path, "text", "_VALUE string")
    return {
        "units": units.select("doc", F.col("_id").alias("id"), F.col("_start").alias("span_start"), F.col("_end").alias("span_end")),
        "complex_units": complex_units.select("doc", F.col("_id").alias("id"), F.coalesce("member", F.array().cast("array<string>")).alias("members")),
        "relations": relations.select("doc", F.col("from").alias("arg1"), F.col("to").alias("arg2"), "type"),
        "texts": texts.select("doc", F.col("_VALUE").alias("text")),
    }


#: Fixed value: the type of a stand-off unit that is an elementary one, and of a connective.
ELEMENTARY, CONNECTIVE = "UDE", "Connecteur"
PLACE = "positioning struct<start: struct<singlePosition: struct<_index: int>>, end: struct<singlePosition: struct<_index: int>>>"
KIND = "characterisation struct<type: string>"
REFERS = "array<struct<_id: string>>"


def read_standoff(spark: SparkSession, annotations: str, texts: str) -> dict[str, DataFrame]:
    """units (of all types, with type), relations, complex_units and texts of stand-off files.

    Texts have their line ends made `\\n`; a file's annotations and text share a stem.
    """
    units = _rows(spark, annotations, "unit", f"_id string, {KIND}, {PLACE}")
    relations = _rows(spark, annotations, "relation", f"_id string, {KIND}, positioning struct<term: {REFERS}>")
    schemas = _rows(spark, annotations, "schema", f"_id string, {KIND}, positioning struct<`embedded-unit`: {REFERS}>")
    whole = spark.read.text(texts, wholetext=True).select("value", stem(F.col("_metadata.file_path")).alias("doc"))
    kind = F.trim("characterisation.type").alias("type")
    spans = units.select(
        "doc", F.col("_id").alias("id"), kind, F.col("positioning.start.singlePosition._index").alias("span_start"),
        F.col("positioning.end.singlePosition._index").alias("span_end"),
    )
    text = whole.select("doc", F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    piece = F.expr("substring(text, span_start + 1, span_end - span_start)")
    return {
        "units": spans.join(text, "doc", "left").withColumn("unit_text", piece).drop("text"),
        "relations": relations.select("doc", F.col("positioning.term")[0]["_id"].alias("arg1"), F.col("positioning.term")[1]["_id"].alias("arg2"), kind),
        "complex_units": schemas.select("doc", F.col("_id").alias("id"), kind, F.transform("positioning.embedded-unit", lambda x: x["_id"]).alias("members")),
        "texts": text,
    }


def elementary(units: DataFrame) -> DataFrame:
    return units.where(F.col("type") == ELEMENTARY)


def read_markers(units: DataFrame) -> DataFrame:
    """(doc, id, form, span): the connectives among stand-off units."""
    return units.where(F.col("type") == CONNECTIVE).select("doc", "id", F.col("unit_text").alias("form"), "span_start", "span_end")


def read_parsed_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tokens with columns, a map of morphology, extent and governor, by document and sentence.

    Raises if a token governs itself, or if its governor is not a token of the sentence
    and not `root`.
    """
    attrs = "_ID string, _FORM string, _LEMMA string, _CPOSTAG string, _POSTAG string, _FEATS string, _HEAD string, _DEPREL string"
    rows = _rows(spark, path, "mst_parse", f"_id string, token array<struct<conll: struct<{attrs.replace(' string', ': string')}>, extent: struct<_START: int, _END: int>>>")
    rows = rows.select("doc", F.col("_id").alias("sent_id"), F.explode("token").alias("t")).select("doc", "sent_id", "t.conll.*", "t.extent.*")
    names = {"_ID": "tok_id", "_FORM": "form", "_LEMMA": "lemma", "_CPOSTAG": "cpos", "_POSTAG": "pos", "_HEAD": "head", "_DEPREL": "deprel", "_START": "span_start", "_END": "span_end"}
    feats = F.when(F.coalesce(F.col("_FEATS"), F.lit("_")) != "_", F.str_to_map("_FEATS", F.lit(r"\|"), F.lit("=")))
    out = rows.withColumn("feats", feats).drop("_FEATS").withColumnsRenamed(names)
    known = out.select("doc", "sent_id", F.col("tok_id").alias("head"))
    lost = out.where("deprel <> 'root'").join(known, ["doc", "sent_id", "head"], "left_anti")
    if (bad := out.where("head = tok_id").unionByName(lost.select(*out.columns)).first()) is not None:
        raise ValueError(f"bad governor: {tuple(bad)}"[:1000])
    return out
