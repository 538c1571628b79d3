"""Ranks and permutations against plain versions, with ties, nulls, hot values and groups."""

import random

import pytest
from pyspark.sql import functions as F

from rhetree.operators import report as R


def average_ranks(values):
    order = sorted(values)
    return {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(order)}


@pytest.mark.parametrize("kinds", [1, 3, 5000])
def test_ranked_values(spark, kinds):
    rng = random.Random(kinds)
    rows = [(rng.choice("ab"), rng.choice([float(rng.randrange(kinds)), 0.0, -2.5, None])) for _ in range(4000)]
    got = {(r.g, r.v): (r.n, r["rank"]) for r in R.ranked_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "ab":
        own = [v for x, v in rows if x == g and v is not None]
        assert {v: got[g, v] for v in set(own)} == {v: (own.count(v), r) for v, r in average_ranks(own).items()}
    assert R.ranked_values(spark.createDataFrame([], "v double"), [], "v").collect() == []


def test_rank_tests(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(12) / 4, rng.randrange(12) / 4) for i in range(700)]
    frame = spark.createDataFrame(rows, "i int, x double, y double")
    d = [round(x - y, 12) for _, x, y in rows if x != y]
    rank = average_ranks([abs(x) for x in d])
    up, down = (sum(rank[abs(x)] for x in d if s * x > 0) for s in (1, -1))
    row = R.wilcoxon(frame, "x", "y").first()
    assert (row.n, row.statistic) == (len(d), pytest.approx(min(up, down)))
    long = frame.select(F.explode(F.expr("array(struct('a' AS g, x AS v), struct('b' AS g, y AS v))")).alias("s")).select("s.*")
    rank = average_ranks([v for _, x, y in rows for v in (x, y)])
    u = sum(rank[x] for _, x, _ in rows) - 700 * 701 / 2
    row = R.mann_whitney(long, "v", "g", "a").first()
    assert (row.n1, row.n2, row.u) == (700, 700, pytest.approx(u)) and 0 <= row.p <= 1


@pytest.mark.parametrize("ordered,bits", [(4096, 12), (3, 2), (1, 5)])
def test_permutations_take_the_least_hashes(spark, monkeypatch, ordered, bits):
    monkeypatch.setattr(R, "ORDERED", ordered)
    monkeypatch.setattr(R, "REFINED_BITS", bits)
    rng = random.Random(3)
    rows = [("a" if i % 5 < 2 else "b", float(rng.randrange(9) + (i % 5 < 2))) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, v double").coalesce(1)
    own = [v for g, v in rows if g == "a"]
    hashes = spark.range(300).withColumnRenamed("id", "i").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("perm", "i", R.permutation_hash(7).alias("h"))
    by = {}
    for r in hashes.collect():
        by.setdefault(r.perm, []).append((r.h, r.i))
    sums = [sum(rows[i][1] for _, i in sorted(hs)[: len(own)]) for hs in by.values()]
    want = sum(s < sum(own) for s in sums) / 40
    assert R.permutation_test(frame, "v", "g", "a", n=40, seed=7).first().share == pytest.approx(want)
    assert 0 < want


def test_permutations_of_nothing(spark):
    frame = spark.createDataFrame([("b", 1.0), ("b", None)], "g string, v double")
    assert R.permutation_test(frame, "v", "g", "a", n=5).first().share == 0.0
    assert R.permutation_test(frame.limit(0), "v", "g", "a", n=5).first().share == 0.0
