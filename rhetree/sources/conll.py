"""CoNLL files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(doc, sent_ix, tok_ix, cols): blank lines end sentences, blanks separate columns."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    sentences = files.select("doc", F.posexplode(F.split(F.trim("value"), r"\n[ \t\r]*\n\s*")).alias("sent_ix", "s"))
    tokens = sentences.select("doc", "sent_ix", F.posexplode(F.split(F.trim("s"), r"\n")).alias("tok_ix", "t"))
    return tokens.where("trim(t) <> ''").select("doc", "sent_ix", "tok_ix", F.split(F.trim("t"), r"\s+").alias("cols"))


def check_conll(tokens: DataFrame, by: list[str] | None = None, columns: int = 10) -> DataFrame:
    """n_bad: tokens without the right number of columns."""
    return tokens.groupBy(*(by or [])).agg(F.count_if(F.size("cols") != columns).alias("n_bad"))
