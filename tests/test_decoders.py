"""Search decoders over tables, many documents at once, against plain versions of one document."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_decoders as plain
from rhetree.operators import decode as D
from rhetree.operators.decode_corpus import chosen_links, decode_corpus, decode_nbest
from rhetree.operators.projective import projective_tree

PAIRS = "grouping string, pair_ix long, parent string, child string, attach double, coordinating boolean"
UNITS = "grouping string, id string, span_start int, span_end int"


def corpus(seed, docs, most, drop=0.15, odd=0.05):
    """Random documents: some without ROOT, with overlapping units, without some links, with certain and impossible links."""
    rng, pairs, units, out = random.Random(seed), [], [], {}
    for d in range(docs):
        n, fake, wild = rng.randrange(2, most + 1), rng.random() < 0.7, d % 3 == 0
        name = lambda i, fake=fake: "ROOT" if fake and not i else f"x{i:03}"
        spans = [(-1, -1) if fake else (-100, -90)] + [(s := 10 * i + (rng.randrange(-12, 12) if wild else 0), s + (rng.randrange(15) if wild else 9)) for i in range(1, n)]
        order = [0, *sorted(range(1, n), key=lambda i: (spans[i], name(i)))]
        place = {i: k for k, i in enumerate(order)}
        links = {}
        for i, j in itertools.product(range(n), range(1, n)):
            if rng.random() >= drop:
                w = rng.choice([0.0, 1.0]) if rng.random() < odd else rng.uniform(0.05, 0.95)
                row = (f"g{d}", len(links), name(i), name(j), w, rng.random() < 0.5)
                pairs.append(row)
                if i != j:
                    links[place[i], place[j]] = (row[1], w, row[5])
                else:
                    links[place[i], place[j]] = (row[1], w, False)
        seen = {x for link in links for x in link}
        units += [(f"g{d}", name(i), *spans[i]) for i in range(n) if name(i) != "ROOT"]
        if len(seen) == n:
            out[f"g{d}"] = plain.Doc(n, {x: v for x, v in links.items() if x[0] != x[1]}, [spans[i] for i in order])
    return pairs, units, out


@pytest.fixture(scope="module")
def small(spark):
    pairs, units, docs = corpus(5, 60, 6)
    return spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(units, UNITS), docs


def found(small, decoder, **options):
    weights, units, docs = small
    got = {}
    for r in chosen_links(weights, units, decoder, **options).collect():
        got.setdefault((r.grouping, r.k), []).append(r.pair_ix)
    for name, doc in docs.items():
        at = {ix: link for link, (ix, *_) in doc.links.items()}
        k = max((k for g, k in got if g == name), default=0)
        yield name, doc, [[at[ix] for ix in got[name, i]] for i in range(1, k + 1)]


def test_neighbours(spark, small):
    for name, doc, _ in found(small, "greedy"):
        near = plain.near(doc)
        rows = [(name, str(i), *doc.spans[i]) for i in range(doc.n)]
        if name in ("g0", "g1", "g3", "g6", "g9", "g12"):
            got = {(int(r.one), int(r.two)) for r in D.neighbours(spark.createDataFrame(rows, UNITS)).collect()}
            assert got == {(a, b) for a in range(doc.n) for b in near[a]}


def test_trees_are_best(small):
    for _, doc, ways in found(small, "mst"):
        tree = ways[0] if ways else []
        assert len({c for _, c in tree}) == len(tree)
        left = (doc.n - 1 - len(tree)) * -plain.FAR**2
        assert doc.total(tree, True) + left == pytest.approx(plain.best_tree(doc))


def test_dag_is_greedy(small):
    trees = {name: ways for name, _, ways in found(small, "mst")}
    for name, doc, ways in found(small, "msdag"):
        assert set(ways[0] if ways else []) == plain.dag(doc, trees[name][0] if trees[name] else [])


@pytest.mark.parametrize("one_root", [True, False])
def test_projective_trees_are_best(small, one_root):
    for _, doc, ways in found(small, "eisner", one_root=one_root):
        tree = ways[0] if ways else []
        fit = lambda t: plain.projective(t) and (not one_root or sum(p == 0 for p, _ in t) == 1)
        assert plain.projective(tree)
        left = (doc.n - 1 - len(tree)) * -plain.FAR**2
        assert doc.total(tree, False) + left == pytest.approx(plain.best_tree(doc, fit, odds=False))


def test_greedy(small):
    for _, doc, ways in found(small, "greedy"):
        assert set(ways[0] if ways else []) == plain.greedy(doc)


@pytest.mark.parametrize("frontier", ["none", "simple", "full"])
@pytest.mark.parametrize("nbest,options", [(1, {"heuristic": "best"}), (1, {"heuristic": "max"}), (3, {}), (2, {"beam": 2000})])
def test_reading_order(small, frontier, nbest, options):
    for _, doc, ways in found(small, "reading_order", frontier=frontier, nbest=nbest, **options):
        want = plain.reading_order(doc, frontier, nbest)
        assert [-doc.total(w, False) for w in ways] == pytest.approx([cost for cost, _ in want])


def test_beam_and_heuristics(small):
    best = {name: ways for name, _, ways in found(small, "reading_order", frontier="simple")}
    for name, doc, ways in found(small, "reading_order", frontier="simple", beam=1):
        assert not ways or doc.total(ways[0], False) <= doc.total(best[name][0], False) + 1e-9
    with pytest.raises(ValueError, match="heuristic"):
        list(found(small, "reading_order", heuristic="worst"))
    with pytest.raises(ValueError, match="decoder"):
        list(found(small, "other"))


def test_four_units(spark):
    pairs = [("g", k, f"x{i}", f"x{j}", w, False) for k, (i, j, w) in enumerate([(0, 1, 0.8), (0, 2, 0.4), (0, 3, 0.5), (1, 2, 0.2), (1, 3, 0.2), (2, 3, 0.2)])]
    weights, units = spark.createDataFrame(pairs, PAIRS), spark.createDataFrame([("g", f"x{i}", i, i) for i in range(4)], UNITS)
    n = lambda d, **o: decode_corpus(weights, units, d, 9, **o).where("prediction <> 9").count()
    assert n("mst") == 3 and n("msdag") == 6 and n("greedy") > 0 and n("mst", root="leftmost") == 3
    assert sorted(r.pair_ix for r in decode_corpus(weights, units, "reading_order", 9).where("prediction = 0").collect()) == [0, 1, 2]
    three = decode_nbest(weights, units, 9, 3).groupBy("k").agg(F.count_if(F.col("prediction") == 0).alias("n")).collect()
    assert sorted((r.k, r.n) for r in three) == [(1, 3), (2, 3), (3, 3)]
    raw = decode_corpus(weights.withColumn("attach", F.col("attach") * 10 - 4), units, "eisner", 9, use_prob=False)
    assert raw.where("prediction = 0").count() == 3
    assert decode_corpus(weights.limit(0), units, "mst", 9).collect() == []
    mine = decode_corpus(weights, units, lambda rows: rows.where("attach > 0.45").select("grouping", "pair_ix"), 9)
    assert mine.where("prediction = 0").count() == 2


def test_tree_of_300_units(spark):
    """One long document beside short ones: a link is a row, whatever document it is in."""
    n = 300
    w = np.random.default_rng(3).uniform(0.01, 0.99, (n, n))
    name = lambda i: f"u{i:03}" if i else "ROOT"
    pairs = [("long", i * n + j, name(i), name(j), float(w[i, j]), False) for i in range(n) for j in range(1, n) if i != j]
    short, units, _ = corpus(8, 5, 5)
    weights = spark.createDataFrame(pairs + short, PAIRS).repartition(4)
    spans = spark.createDataFrame(units + [("long", name(i), i, i) for i in range(1, n)], UNITS)
    got = {r.pair_ix % n: r.pair_ix // n for r in chosen_links(weights, spans, "mst").where("grouping = 'long'").collect()}
    odds = np.log(w / (1 - w))
    want = plain.arborescence(odds)
    assert len(got) == n - 1
    assert sum(odds[p, c] for c, p in got.items()) == pytest.approx(sum(odds[want[c], c] for c in range(1, n)))
    order = {r.pair_ix % n: r.pair_ix // n for r in chosen_links(weights, spans, "reading_order").where("grouping = 'long'").collect()}
    assert order == {c: int(w[:c, c].argmax()) for c in range(1, n)}


def shuffled(spark, since=0):
    """(rows written to shuffles by stages from number `since`, the next stage's number)."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in each if s.stageId() >= since), max(s.stageId() for s in each) + 1


def test_projective_tree_of_14_units(spark):
    """More rounds than keep their tables; a round shuffles rows for spans, not for splits or for the spans before."""
    n, rng = 14, random.Random(7)
    score = {(p, c): rng.choice([0.1, 0.4, rng.random()]) for p, c in itertools.product(range(n), range(1, n)) if p != c and rng.random() < 0.9}
    score |= {(c - 1, c): 0.01 for c in range(1, n)}
    rows = [("g", p, c, n * p + c, 0, float(np.log(w))) for (p, c), w in score.items()] + [("h", 0, 1, 1, 0, -1.0)]
    links = spark.createDataFrame(rows, "grouping string, p int, c int, pair_ix long, high long, low double").repartition(2).localCheckpoint()
    since, threshold = shuffled(spark)[1], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # as with tables too large to be sent around
    try:
        got = projective_tree(links, ["grouping"]).collect()
    finally:
        spark.conf.unset(threshold)
    assert shuffled(spark, since)[0] < 8 * n * n
    tree = [divmod(r.pair_ix, n) for r in got if r.grouping == "g"]
    assert len(tree) == n - 1 and plain.projective(tree) and sum(p == 0 for p, _ in tree) == 1
    assert [r.pair_ix for r in got if r.grouping == "h"] == [1]
    assert sum(np.log(score[link]) for link in tree) == pytest.approx(plain.best_projective(n, {x: np.log(w) for x, w in score.items()}))
