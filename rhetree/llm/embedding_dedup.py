"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors are cut into tiles. A tile pair is multiplied in int8 (held in floats, where the
integer sums are exact); each vector's quantisation error bounds how far a product can
lie from the true cosine, and only pairs that may reach the threshold are computed in
double precision. Equal vectors are one vector with a count.

Tiles follow a bounded set of pivots: vectors lie with their nearest pivot, pivots of few
vectors share a tile with others near them, and two tiles whose pivots are all too far
apart for a link are never paired. A vector becomes a row per tile in reach, so where
nothing is too far apart as many rows as there are times TILE vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .components import components, least_labels

THRESHOLD = 0.9
#: Vectors of a tile; rows of a tile that are multiplied at once.
TILE = 4096
ROWS = 512
#: Vectors drawn as pivots at most, whatever the size of the table.
PIVOTS = 128
#: More than any rounding of the bound's own arithmetic in 32-bit floats.
SLACK = 1e-4


def _quantised(unit: np.ndarray):
    """int8 steps (as floats), scale, error norm and norm of the rounded vector, by row."""
    scale = np.abs(unit).max(axis=1) / 127
    steps = np.rint(unit / scale[:, None])
    near = steps * scale[:, None]
    return (
        steps.astype(np.float32 if unit.shape[1] <= 1000 else np.float64),
        scale.astype(np.float32),
        np.linalg.norm(unit - near, axis=1).astype(np.float32),
        np.linalg.norm(near, axis=1).astype(np.float32),
    )


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool):
    """Yields (i, j) arrays of linked pairs of two tiles, rows of `left` in blocks."""
    ln, rn = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    lq, ls, le, lm = _quantised(left / ln[:, None])
    rq, rs, re, _ = _quantised(right / rn[:, None])
    for at in range(0, len(left), ROWS):
        rows = slice(at, at + ROWS)
        bound = lq[rows] @ rq.T
        bound *= rs
        bound *= ls[rows, None]
        # u.v = u'.v' + u'.(v - v') + (u - u').v, and v has norm 1
        bound += lm[rows, None] * re
        i, j = np.nonzero(bound >= (threshold - SLACK) - le[rows, None])
        i += at
        if same:
            i, j = i[i != j], j[i != j]
        linked = np.zeros(len(i), bool)
        for k in range(0, len(i), 200_000):
            a, b = i[k : k + 200_000], j[k : k + 200_000]
            linked[k : k + 200_000] = np.einsum("ij,ij->i", left[a], right[b]) / (ln[a] * rn[b]) >= threshold
        yield i[linked], j[linked]


def _pair(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """What a tile pair finds: (a, null, n) sums of linked vectors, (a, b, 0) a forest of links."""
    one = group[group["tile"] == group["lo"]]
    same = bool(group["lo"].iloc[0] == group["hi"].iloc[0])
    two = one if same else group[group["tile"] == group["hi"]]
    ids = np.concatenate([one["gid"], [] if same else two["gid"]]).astype(np.int64)
    shift = 0 if same else len(one)
    sums = np.zeros(len(ids), np.int64)
    forest_a, forest_b = [], []
    if len(one) and len(two):
        left = np.stack(one["embedding"].to_numpy()).astype(np.float64)
        right = left if same else np.stack(two["embedding"].to_numpy()).astype(np.float64)
        many_l, many_r = one["mult"].to_numpy(), two["mult"].to_numpy()
        for i, j in tile_links(left, right, threshold, same):
            np.add.at(sums, i, many_r[j])
            if not same:
                np.add.at(sums, j + shift, many_l[i])
            label = least_labels(len(ids), i, j + shift)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            forest_a.append(moved)
            forest_b.append(label[moved])
    if forest_a:
        label = least_labels(len(ids), np.concatenate(forest_a), np.concatenate(forest_b))
        moved = np.flatnonzero(label != np.arange(len(ids)))
    else:
        moved = label = np.zeros(0, np.int64)
    some = np.flatnonzero(sums)
    return pd.DataFrame(
        {
            "a": np.concatenate([ids[some], ids[moved]]),
            "b": pd.array(np.concatenate([np.full(len(some), -1), ids[label[moved]]]), dtype="Int64"),
            "n": np.concatenate([sums[some], np.zeros(len(moved), np.int64)]),
        }
    )


def _bins(count: dict[int, int], between: np.ndarray, tile: int) -> list[list[int]]:
    """The pivots dealt into bins of at most `tile` vectors; one that has more is a bin of its own.

    Pivots follow each other by nearness, so that those of a bin lie close together.
    """
    left, bins, held = set(count), [], tile
    at = min(left, default=0)
    while left:
        at = min(left, key=lambda p: (between[at, p], p))
        left.remove(at)
        if held + count[at] > tile:
            bins, held = [*bins, []], 0
        bins[-1].append(at)
        held += count[at]
    return bins


def _tiles(vectors: DataFrame, dim: int, threshold: float, tile: int, pivots: int) -> DataFrame:
    """Rows (lo, hi, tile, gid, mult, embedding): each vector for every tile pair it belongs to."""
    spark = vectors.sparkSession
    drawn = vectors.orderBy(F.xxhash64("gid")).limit(pivots).select("embedding").collect()
    centre = np.array([r[0] for r in drawn], np.float64)
    centre /= np.linalg.norm(centre, axis=1)[:, None]

    @F.pandas_udf("pivot int, angle double")
    def nearest(embedding: pd.Series) -> pd.DataFrame:
        unit = np.stack(embedding.to_numpy()).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        cosine = unit @ centre.T
        best = cosine.argmax(axis=1)
        return pd.DataFrame({"pivot": best.astype(np.int32), "angle": np.arccos(np.clip(cosine.max(axis=1), -1, 1))})

    placed = written(vectors.withColumn("_p", nearest("embedding")).select("gid", "mult", "embedding", "_p.*"), "placed")
    # at most `pivots` rows
    stats = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()
    count = {r["pivot"]: r["n"] for r in stats}
    radius = {r["pivot"]: r["r"] for r in stats}
    reach = np.arccos(threshold) + 1e-6
    between = np.arccos(np.clip(centre @ centre.T, -1, 1))
    bins = _bins(count, between, tile)
    size = [-(-sum(count[p] for p in own) // tile) for own in bins]
    linked = lambda p, q: between[p, q] <= radius[p] + radius[q] + reach
    near = [
        (b, c, size[c]) for b in range(len(bins)) for c in range(len(bins))
        if any(linked(p, q) for p in bins[b] for q in bins[c])
    ]
    partners = spark.createDataFrame(near, "bin int, other int, chunks int")
    chunks = spark.createDataFrame([(p, b, size[b]) for b, own in enumerate(bins) for p in own], "pivot int, bin int, own int")
    code = lambda p, c: F.shiftleft(p.cast("long"), 40) + c
    return (
        placed.join(F.broadcast(chunks), "pivot")
        .withColumn("tile", code(F.col("bin"), F.pmod(F.xxhash64("gid"), F.col("own"))))
        .join(F.broadcast(partners), "bin")
        .withColumn("partner", F.explode(F.expr("sequence(0, chunks - 1)")))
        .withColumn("partner", code(F.col("other"), F.col("partner")))
        .select(
            F.least("tile", "partner").alias("lo"), F.greatest("tile", "partner").alias("hi"),
            "tile", "gid", "mult", "embedding",
        )
    )


def embedding_links(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding).

    Rows whose vector is null, empty, zero, or holds null or non-finite components link
    with nothing: they have n_links 0 and are their own component. Vectors of different
    lengths do not link. Rows of equal vectors link with each other, also those that
    share a vec_id; component_id is the smallest vec_id that is not null.
    """
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fits = F.coalesce(
        (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    # the unscaled norm must neither overflow nor vanish
    top = F.array_max(F.transform("embedding", F.abs))
    rows = rows.withColumn("embedding", F.when(fits, F.transform("embedding", lambda x: x / top)))
    distinct = (
        rows.where("embedding IS NOT NULL")
        .groupBy("embedding")
        .agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
        .withColumn("gid", F.monotonically_increasing_id())
    )
    vectors = written(distinct, "vectors")
    found = None
    # a table of embeddings has one length, as a rule
    for (dim,) in vectors.select(F.size("embedding")).distinct().collect():
        own = vectors.where(F.size("embedding") == dim)
        pairs = _tiles(own, dim, threshold, tile, pivots)
        part = pairs.groupBy("lo", "hi").applyInPandas(lambda g: _pair(g, threshold), "a long, b long, n long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    found = written(found, "found")
    sums = found.where("n > 0").groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n"))
    parts = components(found.where("n = 0").select("a", "b"), "vector-links").withColumnRenamed("node", "gid")
    joined = (
        vectors.join(sums, "gid", "left")
        .join(parts, "gid", "left")
        .select(
            "embedding", "least", "mult",
            (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
            F.coalesce("component", "gid").alias("component"),
        )
    )
    joined = written(joined, "linked")
    # neither a component's vectors nor a vector's copies meet in one task
    many, rows_of = joined.agg(F.count(F.lit(1)), F.sum("mult")).first()
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = spread_join(joined, names, "component", "members", many)
    named = written(named.select("embedding", "n_links", "component_id", "mult"), "named")
    out = spread_join(rows.where("embedding IS NOT NULL"), named, "embedding", "mult", rows_of)
    alone = rows.where("embedding IS NULL").select("*", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
