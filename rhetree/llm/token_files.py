"""Token ids in Parquet files that can be read in part.

A file holds rows (doc_id, n_tokens, ids) in ascending doc_id order, and files follow
each other in that order. `ids` is a list column in dictionary encoding (a vocabulary's
ids are few and repeat; pages whose dictionary would grow too large fall back to delta
encoding), cut into row groups and pages of set sizes with page indexes. Reading only
doc_id and n_tokens never touches the ids; a range of doc_ids reads only its pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, text_of
from .encoding import ENCODE_BYTES, encoder, slices, tidied, with_end

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: Settings of the Parquet writer; version 2 has delta encoding for integers.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
}


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens long, ids array<int>) of each document, its ids followed by `end_id`.

    A null text counts as empty and has the end id alone. Rows keep their order.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer, words_only=True)
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, lengths = with_end(*pieces.encode(batch.column("text")), end_id)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths.astype(np.int64)), lists], ["doc_id", "n_tokens", "ids"]
            )

    slim = docs.select("doc_id", text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidied(encode), f"doc_id {kind}, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes the documents' ids in ascending doc_id order (null first), equal doc_ids by text.

    The texts are dealt out by ranges of doc_id and sorted before they are encoded, so
    that they are encoded once, in the task that writes them.
    """
    slim = docs.select("doc_id", text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions("doc_id", "text")
    tokenized(ordered, tokenizer, end_id).write.options(**LAYOUT).parquet(path)


def read_tokens(spark, path: str, key_type: str = "long") -> DataFrame:
    """doc_id, n_tokens, ids and where a row lies: `file` and `row`, its number in the file.

    `key_type` is the type of doc_id in the files.
    """
    rows = spark.read.schema(f"doc_id {key_type}, n_tokens long, ids array<int>").parquet(path)
    return rows.select(
        "doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def file_number(file: Column) -> Column:
    """The number of a file in the order of writing: names as text go wrong from 100,000 files on."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def starts(spark, path: str, key_type: str = "long") -> DataFrame:
    """(file, row, start): the ids of all documents before each, from the metadata columns alone.

    Only one sum per file is ordered as a whole; running sums are within files. A task
    that writes several files numbers them in its order after its own number.
    """
    rows = read_tokens(spark, path, key_type).select("file", "row", "n_tokens")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(file_number(F.col("file")), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ahead = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))
    return within.join(files, "file").select("file", "row", (F.col("first") + F.col("own")).alias("start"))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, file, row, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            own = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            kept = [batch.column(c) for c in ("doc_id", "file", "row")]
            counted = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*kept, counted, pa.array(own, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "file", "row", "ids").mapInArrow(
        tidied(sums), f"doc_id {kind}, file string, row long, n_tokens long, ids_crc32 long"
    )


def token_file_digest(docs: DataFrame) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32 of each document.

    A null text counts as empty: its only id is the end id. Rows of equal or null doc_id
    stand side by side in any order (nulls first), each with its own ids; an empty table
    gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    path, kind = new_path(spark, "tokens"), docs.schema["doc_id"].dataType.simpleString()
    write_tokens(docs, path)
    found = checksums(read_tokens(spark, path, kind))
    return found.join(starts(spark, path, kind), ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")
