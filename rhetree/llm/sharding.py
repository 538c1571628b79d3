"""Proportional stratified interleaving: shards that all hold the corpus's mixture.

Rows of each source are put in a seeded random order and ranked; sorting all rows by
their fractional rank (rank + 0.5) / rows of the source spreads every source evenly
over the whole order, so that any cut of it holds each source in its proportion.

No source is ever gathered in one task. The random key of a row is uniform, so its top
bits deal a source's rows into buckets whose counts give every bucket its first rank;
only inside a bucket are rows numbered. Fractional ranks are uniform too, and the final
order is numbered in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Hex digits of the random key that make a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3
#: Buckets of the fractional rank.
RANK_BUCKETS = 4096


def shuffle_key(seed: int, *columns: str) -> Column:
    """A uniform random key of a row as 32 hex digits (md5; both Spark and SQL have it)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def _ranked(rows: DataFrame, within: list[str], bucket: str, order: list, rank: str, total: str) -> DataFrame:
    """Adds `rank` (from 0) of each row in `order` within the `within` columns, and `total`.

    `bucket` must be monotone in `order`; only counts per bucket are ordered as a whole.
    """
    counts = rows.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_o_{c}") for c in [*within, bucket]],
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"),
        F.sum("_n").over(Window.partitionBy(*within)).alias(total),
    )
    same = F.lit(True)
    for c in [*within, bucket]:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    number = F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order)) - 1
    return (
        rows.join(offsets, same)
        .withColumn(rank, (F.col("_first") + number).cast("long"))
        .drop("_first", *[f"_o_{c}" for c in [*within, bucket]])
    )


def stratified_shards(
    rows: DataFrame, n_shards: int, identity: list[str], stratum: str = "source", seed: int = 13
) -> DataFrame:
    """Adds `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    `identity` are the columns that order equal keys; rows equal in all of them are
    interchangeable. A column of `rows` named shard or slot is replaced. Shards differ by at most one row, and each holds any source in its
    share of the corpus to within two rows. A null stratum is a stratum of its own, an
    empty table gives an empty table, repeated rows are dealt out like any others, other
    columns pass through.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    # the row itself rides along in one column, so that its own names cannot clash
    own = [f"_i{k}" for k in range(len(identity))]
    keyed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"),
        F.col(stratum).alias("_stratum"),
        shuffle_key(seed, *identity).alias("_key"),
        *[F.col(c).alias(o) for c, o in zip(identity, own, strict=True)],
    ).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    ranked = _ranked(keyed, ["_stratum"], "_bucket", ["_key", *own], "_rank", "_of")
    fraction = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_of").cast("double"))
    fraction = fraction.withColumn("_slice", F.floor(F.col("_f") * RANK_BUCKETS)).withColumn("_all", F.lit(0))
    # `_all` has one value: what is ordered by it are at most RANK_BUCKETS counts.
    placed = _ranked(fraction, ["_all"], "_slice", ["_f", "_key", *own], "_at", "_rows")
    shard = F.expr(f"(_at * {n_shards}) div _rows")
    first = F.expr(f"(((_at * {n_shards}) div _rows) * _rows + {n_shards - 1}) div {n_shards}")
    kept = [F.col(f"_row.`{c}`") for c in rows.columns if c not in ("shard", "slot")]
    return placed.select(*kept, shard.cast("int").alias("shard"), (F.col("_at") - first).cast("long").alias("slot"))


def mixture(sharded: DataFrame, stratum: str = "source") -> DataFrame:
    """Rows of each stratum in each shard: what the interleaving keeps equal."""
    return sharded.groupBy("shard", stratum).agg(F.count(F.lit(1)).alias("n_rows"))


def sharding_digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document.

    The text itself is never shuffled: its size and checksum are. Size is the UTF-8 bytes
    of the text (null: none) plus 8; a null text has the checksum of the empty one. The
    law is `rows`: shards differ by at most one row, so a further shard moves rows
    anywhere and grown_shard is null.
    """
    slim = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    dealt = stratified_shards(slim, n_shards, ["doc_id", "text_crc32", "size", "source"])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )
