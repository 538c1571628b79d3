"""Proportional interleaving against sorting the rows by hand."""

import hashlib
import random
import zlib

import pytest

from rhetree.llm import sharding


def interleaved(rows, n_shards, seed=13):
    """(shard, slot) of each row (doc_id, source, text): shuffled within its source, all sorted by fractional rank, cut into equal parts."""
    def key(doc_id, source, text):
        parts = [doc_id, zlib.crc32(text.encode()), len(text.encode()) + 8, source]
        return hashlib.md5("|".join([str(seed), *["~" if p is None else str(p) for p in parts]]).encode()).hexdigest()

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((key(*r), r))
    order = sorted(((k + 0.5) / len(own), name, r) for own in by.values() for k, (name, r) in enumerate(sorted(own, key=lambda x: x[0])))
    n, out, filled = len(rows), {}, [0] * n_shards
    for at, (_, _, r) in enumerate(order):
        shard = at * n_shards // n
        out[r[0]] = (shard, filled[shard])
        filled[shard] += 1
    return out


@pytest.mark.parametrize("n,n_shards", [(1, 24), (23, 24), (24, 24), (500, 24), (500, 7)])
def test_against_a_plain_sort(spark, n, n_shards):
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice(["", "é" * rng.randrange(9), "same text"])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.sharding_digest(docs, n_shards).collect()}
    assert got == interleaved(rows, n_shards)


def test_clashing_names_nulls_and_repeats(spark):
    rows = [(1, None, None, 5, "k", "r"), (1, None, None, 5, "k", "r"), (None, "a", "x", None, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, shard int, _key string, _row string")
    out = sharding.sharding_digest(docs, 4)
    assert out.count() == 60 and {(r.shard, r.slot) for r in out.collect()} == {(s, k) for s in range(4) for k in range(15)}
    own = sharding.stratified_shards(docs, 4, ["doc_id"])
    assert own.columns == ["doc_id", "source", "text", "_key", "_row", "shard", "slot"] and own.count() == 60
