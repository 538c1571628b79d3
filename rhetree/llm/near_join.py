"""N-gram Jaccard join by a MinHash LSH forest.

Each distinct set of five-word shingles has a MinHash label per tree. Sets whose labels
in a tree share a prefix lie in one subtree of its sorted trie. The join begins with the
longest prefixes, verifies every pair that shares one exactly, and estimates from the
links found how many it missed (a pair of similarity s shares a prefix of depth d in one
of L trees with probability 1 - (1 - s^d)^L). While the estimated recall is under the
target, prefixes are made one shorter, and only pairs that did not meet before are new.

Members of small subtrees give pairs. A large subtree is named by its least member, its
leader; sets that share a leader in any tree form one group, which is dealt into blocks
of bounded size. Pairs of blocks are verified inside tasks that return sums and a forest
of links, never the pairs themselves. A pair of several groups counts in that of the
least leader, and a pair that shares a leader is no pair of a small subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import concluded, in_buckets, spread_join, text_of, written
from .components import components, least_labels
from .encoding import release, slices, tidied
from .shingles import as_sets, common_counts, minhashes, multipliers, shingle_hashes, word_hashes

TREES = 32
DEPTH = 8
#: Bytes of a level of a label.
LEVEL = 2
TARGET_RECALL = 0.9995
#: The least chance of a pair at the threshold to share a prefix; the first prefixes reach it.
LEAST_CHANCE = 0.999
#: Members up to which a subtree gives pairs; members and shingles of a block of a group.
SMALL = 64
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
SEED = 5


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, row_key, set_id, n_shingles, labels of each document.

    set_id names the set of shingles (128 bits), null if the text has no word; text_key
    is a hash of the text, row_key of doc_id and text; labels holds TREES labels of DEPTH
    levels of LEVEL bytes.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        factors = multipliers(TREES * DEPTH, SEED)
        for batch in slices(batches, "text"):
            shingles, many = shingle_hashes(*word_hashes(batch.column("text")))
            low = minhashes(shingles, many, factors)
            # the high bits of a minimum are few: mix before cutting
            mixed = ((low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(">u2")
            sets, sizes = as_sets(shingles, many)
            names = _names(sets, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    batch.column("row_key"),
                    pa.array(names, pa.binary()),
                    pa.array(sizes.astype(np.int32)),
                    pa.array([row.tobytes() if n else None for row, n in zip(mixed, sizes, strict=True)], pa.binary()),
                ],
                ["doc_id", "text_key", "row_key", "set_id", "n_shingles", "labels"],
            )

    slim = docs.select("doc_id", text_of().alias("text"), F.xxhash64("text").alias("text_key"), _row_key())
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        tidied(sketch), f"doc_id {kind}, text_key long, row_key long, set_id binary, n_shingles int, labels binary"
    )


def _row_key() -> Column:
    """A hash of doc_id and text: copies of a text differ in it, so that they never meet in one task."""
    return F.xxhash64("doc_id", "text").alias("row_key")


def _names(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(sizes)
    return [
        hashlib.blake2b(sets[e - n : e].tobytes(), digest_size=16).digest() if n else None
        for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)
    ]


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, shingles array<long>) of the wanted sets (sid, set_id, row_key), from one text of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            found, sizes = as_sets(*shingle_hashes(*word_hashes(batch.column("text"))))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64)))
            same = pa.array([a == b for a, b in zip(_names(found, sizes), batch.column("set_id").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("sid"), lists], ["sid", "shingles"]).filter(same)

    texts = docs.select(text_of().alias("text"), _row_key())
    rows = in_buckets(texts, wanted, "row_key").join(wanted, "row_key").select("sid", "set_id", "text")
    # repeated rows give their set again
    return rows.mapInArrow(tidied(sets), "sid long, shingles array<long>").dropDuplicates(["sid"])


def _chance(similarity, depth: int):
    return 1 - (1 - similarity**depth) ** TREES


def _met(label: np.ndarray, depth: int, first: int, shift: int) -> np.ndarray:
    """Whether sets 0 .. first - 1 share a prefix of `depth` levels with sets shift, shift + 1, ... in any tree."""
    out = np.zeros((first, len(label) - shift), bool)
    for tree in range(TREES):
        _, node = np.unique(np.ascontiguousarray(label[:, tree, :depth]).view(f"V{depth * LEVEL}"), return_inverse=True)
        node = node.ravel()
        out |= node[:first, None] == node[None, shift:]
    return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("found", pa.float64()), ("expected", pa.float64())])


def _blocks(group: pa.Table, depth: int, done: int | None) -> pa.Table:
    """Verifies a pair of blocks of one group: sums (a, null, n), a forest (a, b, 0), and the estimate's sums."""
    lo, hi, leader = (group.column(c)[0].as_py() for c in ("lo", "hi", "leader"))
    block = group.column("block").to_numpy()
    one = np.flatnonzero(block == lo)
    both = one if lo == hi else np.concatenate([one, np.flatnonzero(block == hi)])
    n, shift = len(one), 0 if lo == hi else len(one)
    if not n or len(both) == shift:
        return LINKS.empty_table()
    group = group.take(pa.array(both))
    ids, mult = group.column("sid").to_numpy(), group.column("mult").to_numpy()
    flat, sizes = _lists(group.column("shingles"))
    common = common_counts(flat, sizes, n, shift)
    label = np.frombuffer(b"".join(group.column("labels").to_pylist()), ">u2").reshape(len(both), TREES, DEPTH)
    linked = (9 * common >= 4 * (sizes[:n, None] + sizes[None, shift:])) & _met(label, depth, n, shift)
    if done is not None:
        linked &= ~_met(label, done, n, shift)
    leaders, many = _lists(group.column("leaders"))
    less = leaders < leader
    many = np.add.reduceat(less, np.cumsum(many) - many, dtype=np.int64)
    linked &= common_counts(leaders[less], many, n, shift) == 0
    if lo == hi:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    if not len(i):
        return LINKS.empty_table()
    shared, j = common[i, j], j + shift
    chance = _chance(shared / (sizes[i] + sizes[j] - shared), depth)
    sums = np.bincount(i, mult[j], len(both)) + np.bincount(j, mult[i], len(both))
    own = least_labels(len(both), i, j)
    moved, some = np.flatnonzero(own != np.arange(len(both))), np.flatnonzero(sums)
    rest = np.zeros(len(some) + len(moved) - 1)
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate([ids[some], ids[moved]])),
            pa.array(np.concatenate([ids[some], ids[own[moved]]]), mask=np.arange(len(rest) + 1) < len(some)),
            pa.array(np.concatenate([sums[some], np.zeros(len(moved))]).astype(np.int64)),
            pa.array(np.concatenate([[float(len(i))], rest])),
            pa.array(np.concatenate([[(1 / chance).sum()], rest])),
        ],
        schema=LINKS,
    )


def _round(docs: DataFrame, sets: DataFrame, depth: int, done: int | None) -> DataFrame:
    """Links of pairs that share a prefix of `depth` levels, but none of `done`: (a, b, n, found, expected)."""
    prefix = lambda d: F.xxhash64("tree", F.substring(F.col("labels"), F.col("tree") * DEPTH * LEVEL + 1, F.lit(d * LEVEL)))
    # the subtree in which members of one met in the round before
    met_in = F.xxhash64("sid") if done is None else prefix(done)
    placed = (
        sets.select("sid", "n_shingles", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select("sid", "n_shingles", prefix(depth).alias("node"), met_in.alias("deeper"))
    )
    subtrees = placed.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("leader")).where("size > 1")
    members = written(placed.join(subtrees, "node"), "members")
    large = members.where(F.col("size") > SMALL).groupBy("leader", "sid").agg(F.first("n_shingles").alias("n_shingles"))
    large = written(large, "groups")
    # a set has a leader for each tree at most
    leaders = large.groupBy("sid").agg(F.collect_set("leader").alias("leaders"))
    slim = written(sets.select("sid", "set_id", "row_key", "mult", "labels").join(leaders, "sid", "left"), "led-sets")
    small = members.where(F.col("size") <= SMALL)
    left = small.select("node", F.col("sid").alias("a"), F.col("n_shingles").alias("n_a"), F.col("deeper").alias("d_a"))
    right = small.select("node", F.col("sid").alias("b"), F.col("n_shingles").alias("n_b"), F.col("deeper").alias("d_b"))
    # sets of too different sizes cannot be similar enough; pairs of one deeper subtree are verified already
    fits = (F.col("a") < F.col("b")) & (F.greatest("n_a", "n_b") * 4 <= F.least("n_a", "n_b") * 5) & (F.col("d_a") != F.col("d_b"))
    pairs = left.join(right, (left["node"] == right["node"]) & fits).select("a", "b")
    # all trees of a pair in one row
    met = pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")
    own = ["sid", "mult", "leaders"] + (["labels"] if done else [])
    side = lambda x: slim.select(*[F.col(c).alias(f"{c}_{x}") for c in own])
    met = met.join(side("a"), F.col("a") == F.col("sid_a")).join(side("b"), F.col("b") == F.col("sid_b"))
    met = met.where(~F.coalesce(F.arrays_overlap("leaders_a", "leaders_b"), F.lit(False)))
    if done:
        at = lambda t, x: F.substring(F.col(x), t * DEPTH * LEVEL + 1, F.lit(done * LEVEL))
        met = met.where(~F.exists(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: at(t, "labels_a") == at(t, "labels_b")))
    met = written(met.select("a", "b", "mult_a", "mult_b"), "pairs")
    wanted = met.select(F.col("a").alias("sid")).unionAll(met.select("b")).unionAll(large.select("sid")).distinct()
    known = written(_shingle_sets(docs, slim.join(wanted, "sid").select("sid", "set_id", "row_key")), "sets")
    set_of = lambda x: known.select(F.col("sid").alias(x), F.col("shingles").alias(f"s_{x}"))
    checked = met.join(set_of("a"), "a").join(set_of("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    total = F.size("s_a") + F.size("s_b")
    links = checked.select("a", "b", "mult_a", "mult_b", common.alias("c"), total.alias("t")).where("9 * c >= 4 * t")
    chance = 1 - F.pow(1 - F.pow(F.col("c") / (F.col("t") - F.col("c")), F.lit(depth)), F.lit(TREES))
    one = F.lit(1.0)
    direct = links.select(
        F.explode(
            F.array(
                F.struct(F.col("a"), F.col("b"), F.col("mult_b").alias("n"), one.alias("found"), (1 / chance).alias("expected")),
                F.struct(F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), F.col("mult_a").alias("n"), F.lit(0.0).alias("found"), F.lit(0.0).alias("expected")),
            )
        ).alias("x")
    ).select("x.*")
    # groups: every member goes to the pairs of blocks that its block is in
    sizes = large.groupBy("leader").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
    )
    dealt = (
        large.drop("n_shingles").join(sizes, "leader")
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("leader", "sid", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        .join(slim.select("sid", "mult", "labels", "leaders").join(known, "sid"), "sid")
    )
    in_blocks = dealt.groupBy("leader", "lo", "hi").applyInArrow(
        lambda g: _blocks(g, depth, done), "a long, b long, n long, found double, expected double"
    )
    return written(direct.unionAll(in_blocks), "near-links")


def near_links(docs: DataFrame, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """(sketches, (set_id, mult, class_id, n_links) of each set, [(depth, estimated recall)]).

    Two documents link if the Jaccard similarity of their sets of five-word shingles is
    0.8 or more. n_links counts the documents of linked sets and the other documents of
    the same set. Shingles are compared by 64-bit hashes.
    """
    rows = written(sketches(docs), "sketches")
    grouped = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.count(F.lit(1)).alias("mult"),
        F.min("doc_id").alias("least"),
        F.min("row_key").alias("row_key"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("labels").alias("labels"),
    )
    sets = written(grouped.withColumn("sid", F.monotonically_increasing_id()), "distinct-sets")
    found, history, done = None, [], None
    start = max(d for d in range(1, DEPTH + 1) if d == 1 or _chance(0.8, d) >= LEAST_CHANCE)
    for depth in range(start, 0, -1):
        part = _round(docs, sets, depth, done)
        found = part if found is None else found.unionAll(part)
        seen = part.agg(F.sum("found"), F.sum("expected")).first()
        total = (seen[0] or 0.0) + sum(h[2] for h in history)
        # what is known to exist: the links so far, and those estimated beyond this depth's
        missed = (seen[1] or 0.0) - (seen[0] or 0.0) if not history else history[-1][3] - (seen[0] or 0.0)
        missed = max(missed, 0.0)
        recall = total / (total + missed) if total else 1.0
        history.append((depth, recall, seen[0] or 0.0, missed))
        done = depth
        if recall >= target:
            break
    sums = found.groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"), "set-links").withColumnRenamed("node", "sid")
    linked = written(
        sets.select("sid", "set_id", "mult", "least").join(sums, "sid", "left").join(parts, "sid", "left")
        .withColumn("component", F.coalesce("component", "sid")), "linked-sets"
    )
    # a component's least doc_id goes to its sets
    least = linked.groupBy("component").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_sets"))
    named = spread_join(linked, least, "component", "n_sets", linked.count())
    named = named.select("set_id", "mult", "class_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"))
    return rows, written(named, "named-sets"), [h[:2] for h in history]


def near_classes(docs: DataFrame, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, text_key, row_key, class_id, n_links of each document.

    class_id is the smallest doc_id (null last) among the documents that links connect.
    Texts without a word link with nothing; shorter texts than five words are one
    shingle. Repeated rows are documents of their own; an empty table has no classes.
    """
    return concluded(lambda: _classes(docs, target), "classes")


def _classes(docs: DataFrame, target: float) -> DataFrame:
    rows, named, _ = near_links(docs, target)
    slim = rows.select("doc_id", "text_key", "row_key", "set_id")
    placed = spread_join(slim.where("set_id IS NOT NULL"), named, "set_id", "mult", rows.count()).drop("set_id")
    alone = slim.where("set_id IS NULL").select("doc_id", "text_key", "row_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return placed.unionByName(alone)


def near_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its class, its number of links, whether it stands for the class."""
    return near_classes(docs).select(
        "doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def near_filter(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of the smallest doc_id; columns unchanged.

    Where rows share that doc_id, one of them stays (that of the smallest text hash).
    Documents without a word are classes of their own.
    """
    classes = near_classes(docs)
    stays = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    # null doc_ids are no copies of each other: they stay as they are
    stays = stays.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    here = classes.groupBy("doc_id", "text_key", "row_key", "class_id").agg(F.count(F.lit(1)).alias("rows"))
    here = here.join(stays, F.col("doc_id") == F.col("_d"), "left").withColumn(
        "gone", ~F.coalesce(F.col("doc_id").eqNullSafe(F.col("class_id")) & ((F.col("text_key") == F.col("_k")) | F.col("doc_id").isNull()), F.lit(False))
    )
    # only rows that may have to go are shuffled
    touched = written(here.where("gone OR (rows > 1 AND doc_id IS NOT NULL)").groupBy("row_key", "text_key").agg(F.max("gone").alias("gone")), "touched")
    # rows are told apart by two hashes, of doc_id and text and of the text alone
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), _row_key())
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    rest = in_buckets(whole, touched, "row_key", "left_anti").select(*columns)
    hit = in_buckets(whole, touched, "row_key").join(touched, ["row_key", "text_key"], "left")
    passed = hit.where("gone IS NULL").select(*columns)
    repeated = hit.where("NOT gone").dropDuplicates(["row_key", "text_key"]).select(*columns)
    return rest.unionAll(passed).unionAll(repeated)
