"""Chains deeper than a recursive query's limit, and more rows than it allows."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rhetree.operators import parse, rounds, storage, text


def tokens(spark, n, head):
    rows = spark.range(n).select(F.lit("u").alias("unit_id"), F.col("id").alias("tok_ix"), F.expr(head).alias("head_ix"))
    return rows.withColumns({"form": F.concat(F.lit("f"), "tok_ix"), "cpos_tag": F.when(F.col("tok_ix") % 2 == 0, "N").otherwise("V")})


def test_chain_of_1500(spark):
    chain = tokens(spark, 1500, "id - 1")  # 1,124,250 pairs, over the default limit of 1,000,000 rows
    assert {r.tok_ix: (r.n_dependents, r.yield_length) for r in text.token_dependents(chain).collect()} == {
        i: (1499 - i, max(1498 - i, 0)) for i in range(1500)
    }
    paths = {r.tok_ix: r.path for r in text.path_to_root(chain).where("tok_ix IN (0, 3, 1499)").collect()}
    assert paths[0] == [] and paths[3] == ["N", "V", "N"]
    assert len(paths[1499]) == 1499 and paths[1499][:2] == ["N", "V"]
    found = {r.tok_ix: (r.first_ix, r.last_ix) for r in text.mentions(chain).where("tok_ix IN (0, 2)").collect()}
    assert found == {0: (0, 1499), 2: (2, 1499)}


def test_circle_is_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        rounds.ancestors(tokens(spark, 6, "(id + 1) % 6"), ["unit_id"], "tok_ix", "head_ix").collect()


def test_frontier_of_300(spark):
    links = spark.range(2, 302).select(
        F.lit("g").alias("grouping"), F.concat(F.lit("g_"), F.col("id") - 1).alias("parent"), F.concat(F.lit("g_"), "id").alias("child"),
        F.lit("s").alias("psub"), F.lit("s").alias("csub"), F.lit(1).alias("target"),
    )
    first = spark.createDataFrame([("g", "ROOT", "g_1", None, "s", 5)], links.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    found = parse.frontiers(links.unionByName(first), "target", 4)
    assert {(r.side, r.unit) for r in found.collect()} == {("left", "g_1")} | {("right", f"g_{i}") for i in range(1, 302)}


def test_a_cluster_without_a_shared_folder_is_an_error():
    none = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(SimpleNamespace(sparkContext=context, conf=none))


def test_tables_of_the_rounds_are_deleted(spark):
    folder = storage.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = rounds.ancestors(tokens(spark, 40, "id - 1"), ["unit_id"], "tok_ix", "head_ix")
    assert found.count() == 820
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("rhetree-ancestors")
    with pytest.raises(ValueError, match="circle"):
        rounds.ancestors(tokens(spark, 6, "(id + 1) % 6"), ["unit_id"], "tok_ix", "head_ix")
    assert set(os.listdir(folder)) - before == left


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    plans, write = [], rounds.written

    def noted(df, what):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, what)

    monkeypatch.setattr(rounds, "written", noted)
    for query in (text.token_dependents, text.path_to_root, text.mentions):
        plans.append(query(tokens(spark, 20, "id - 1"))._jdf.queryExecution().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_search_states_are_not_broadcast(spark, monkeypatch):
    from rhetree.operators import reading_order

    plans, write = [], reading_order.written

    def noted(df, what):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, what)

    monkeypatch.setattr(reading_order, "written", noted)
    links = spark.createDataFrame([("g", p, c, 10 * c + p, 0, -1.0) for c in range(1, 3) for p in range(c)], "grouping string, p int, c int, pair_ix long, high long, low double")
    assert reading_order.reading_order_trees(links, ["grouping"], frontier="simple", beam=2).count() == 2
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_greedy_tables_are_not_broadcast(spark, monkeypatch):
    from rhetree.operators import greedy

    plans, write = [], greedy.written

    def noted(df, what):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, what)

    monkeypatch.setattr(greedy, "written", noted)
    links = spark.createDataFrame([("g", p, c, 10 * c + p, 0.5) for c in range(1, 4) for p in range(4) if p != c], "grouping string, p int, c int, pair_ix long, attach double")
    near = spark.createDataFrame([("g", a, b) for a in range(4) for b in range(4) if abs(a - b) == 1], "grouping string, p int, c int")
    sizes = spark.createDataFrame([("g", 4)], "grouping string, n long")
    assert greedy.greedy_links(links, near, sizes, ["grouping"]).count() > 0
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
