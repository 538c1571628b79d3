"""Hand-made cases of scores, statistics, learners and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhetree.operators import folds as C
from rhetree.operators import learn as L
from rhetree.operators import pairs as P
from rhetree.operators import report as R
from rhetree.operators import score as M
from rhetree.operators import text as X
from rhetree.plans.bridge import LABELS, UNRELATED_IX, Bridge

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def b(spark):
    return Bridge(spark, DATA)


@pytest.mark.parametrize(
    "heads,labels,want",
    [([0, 1, 2, 1], "abcd", (1, 1, 1)), ([0, 1, 2, 2], "abcd", (0.75, 0.75, 1)), ([0, 1, 2, 1], "abcx", (1, 0.75, 0.75)), ([0, 1, 2, 2], "abcx", (0.75, 0.75, 0.75))],
)
def test_uas_las_ls(spark, heads, labels, want):
    make = lambda hs, ls: spark.createDataFrame([("g", f"u{i}", f"u{h}", x) for i, (h, x) in enumerate(zip(hs, ls, strict=True), 1)], "grouping string, child string, parent string, label string")
    row = M.uas_las_ls(make([0, 1, 2, 1], "abcd"), make(heads, labels)).first()
    assert tuple(row) == want


def test_t_distribution():
    assert R.t_quantile(0.975, 4) == pytest.approx(2.7764451, abs=1e-6)
    assert R.t_quantile(0.975, 30) == pytest.approx(2.0422725, abs=1e-6)
    assert R.t_distribution(0.0, 5) == pytest.approx(0.5)


def test_permutation_share(spark):
    rows = [("a", x) for x in [1, 1, 1, 0, 0] * 5] + [("b", x) for x in [1, 0, 0, 0, 0] * 5]
    frame = spark.createDataFrame(rows, "config string, score int")
    assert R.permutation_test(frame, "score", "config", "a", n=300).first().share > 0.95


def test_folds_are_even(b):
    sizes = [r["count"] for r in C.make_folds(b.units, 3, seed=1).groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        C.make_folds(b.units, 10_000)
    with pytest.raises(ValueError):
        C.fold_groupings(C.make_folds(b.units, 3), 9)


def test_cross_validation_resumes(spark, b, tmp_path):
    folds, runs = C.make_folds(b.units, 2), []

    def run(train, test):
        runs.append(1)
        return test.select("grouping", "pair_ix", F.lit(0).alias("prediction"))

    first = C.cross_validate(b.pairs, folds, {"c": run}, str(tmp_path)).count()
    assert C.cross_validate(b.pairs, folds, {"c": run}, str(tmp_path)).count() == first == b.pairs.count()
    assert len(runs) == 2


def test_fingerprint_ignores_order(b):
    one = R.table_fingerprint(b.pairs).first()
    assert one == R.table_fingerprint(b.pairs.repartition(7)).first()
    assert one != R.table_fingerprint(b.pairs.limit(10)).first()


def test_perceptron_separates(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] > 0, 1.0, -1.0)
    rows = spark.createDataFrame([(a.tolist(), float(s)) for a, s in zip(x, y, strict=True)], "features array<double>, y double")
    for kind in ("perceptron", "pa", "pa2"):
        w = L.train_linear(rows.repartition(2), 3, kind, epochs=5)
        assert (np.sign(x @ w) == y).mean() > 0.9


def test_online_steps_in_one_partition(spark):
    rows = spark.createDataFrame([([1.0, 0.0], 1.0), ([0.0, 1.0], -1.0), ([1.0, 1.0], -1.0)], "features array<double>, y double").coalesce(1)
    w = L.train_linear(rows, 2, "perceptron", epochs=1, average=False)
    assert w.tolist() == [1.0, -1.0] or w.tolist() == [0.0, -2.0]


def test_learned_links_beat_chance(b):
    from rhetree.plans.parse_queries import featured

    rows = featured(b)
    scored = L.fit_attach(rows, UNRELATED_IX, maxIter=20).transform(rows)
    mean = {r.g: r.m for r in scored.groupBy((F.col("target") != UNRELATED_IX).alias("g")).agg(F.avg("attach").alias("m")).collect()}
    assert mean[True] > mean[False]


def test_model_cache(spark, b, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    from rhetree.plans.parse_queries import featured

    rows, runs = featured(b), []
    fit = lambda: runs.append(1) or L.fit_attach(rows, UNRELATED_IX, maxIter=2).model
    for _ in range(2):
        L.cached_model(str(tmp_path / "m"), LogisticRegressionModel, fit)
    assert len(runs) == 1


def test_relabel_needs_a_superset(b):
    with pytest.raises(ValueError):
        P.relabel(b.weights, LABELS, ["ROOT"])


def test_pair_at_threshold(spark):
    rows = [(i, w) for i, w in enumerate([0.44, 0.43, 0.43, 0.44, 0.97, 0.39, 0.01, 0.42, 0.39])]
    from rhetree.operators.decode import decode_threshold

    frame = spark.createDataFrame(rows, "pair_ix int, attach double")
    kept = [r.pair_ix for r in decode_threshold(frame, UNRELATED_IX, 0.4).where(F.col("prediction") != UNRELATED_IX).orderBy("pair_ix").collect()]
    assert kept == [0, 1, 2, 3, 4, 7]


def test_offsets_keep_the_cursor(spark):
    rows = spark.createDataFrame([("The the cat", ["the", "The", "x", "CAT"])], "text string, forms array<string>")
    spans = X.token_offsets(rows).first().spans
    assert [(s.start, s.end) for s in spans] == [(0, 3), (4, 7), (None, None), (8, 11)]


def test_markers_longest_first(spark):
    hits = spark.createDataFrame([("d", 0, 8, "even if"), ("d", 5, 8, "if"), ("d", 9, 12, "but")], "doc string, start int, end int, form string")
    rel = spark.createDataFrame([("even if", "concession", "1"), ("if", "condition", "2"), ("but", "contrast", "3"), ("but", "result", "4")], "form string, relation string, id string")
    rows = {r.form: r.relations for r in X.marker_tagging(hits, rel, ["doc"]).collect()}
    assert rows == {"even if": "concession", "but": "contrast/result"}


def scanned(hits):
    """Starts of what a scan from left to right keeps, the longest hit at a place."""
    kept, at = [], 0
    for start in sorted({s for s, _ in hits}):
        if start >= at:
            kept.append(start)
            at = max(e for s, e in hits if s == start)
    return kept


def test_a_dropped_hit_drops_no_other(spark):
    """as long as if only then: the second of three overlapping hits goes, the third stays."""
    hits = spark.createDataFrame([("d", 0, 10, "as long as"), ("d", 8, 13, "as if"), ("d", 11, 18, "if only")], "doc string, start int, end int, form string")
    rel = hits.select("form", F.lit("r").alias("relation"), F.lit("i").alias("id"))
    assert sorted(r.form for r in X.marker_tagging(hits, rel, ["doc"]).collect()) == ["as long as", "if only"]


def test_leftmost_longest_against_a_scan(spark):
    rng = random.Random(6)
    rows = [(f"d{d}", s, s + rng.randrange(1, 9)) for d in range(40) for s in (rng.randrange(60) for _ in range(rng.randrange(1, 40)))]
    got = X.leftmost_longest(spark.createDataFrame(rows, "doc string, start int, end int"), ["doc"]).collect()
    by = {}
    for d, s, e in rows:
        by.setdefault(d, []).append((s, e))
    assert sorted((r.doc, r.start, r.end) for r in got) == sorted((d, s, max(e for x, e in own if x == s)) for d, own in by.items() for s in scanned(own))


def test_cross_validation_goes_on_where_it_ended(b, tmp_path):
    """Jobs in threads: one that fails stops the run, what had ended is kept and not run again."""
    folds = b.units.select("grouping", (F.col("conv_id") % 2).cast("int").alias("fold")).distinct()
    runs, broken = [], [True]

    def config(name):
        def run(train, test):
            runs.append(name)
            if name == "b" and broken[0]:
                raise RuntimeError("lost")
            return test.select("grouping", "pair_ix", "target")

        return run

    configs = {n: config(n) for n in "abc"}
    with pytest.raises(RuntimeError, match="lost"):
        C.cross_validate(b.pairs, folds, configs, str(tmp_path), test=b.pairs)
    broken[0], before = False, runs.copy()
    out = C.cross_validate(b.pairs, folds, configs, str(tmp_path), test=b.pairs)
    assert sorted(runs[len(before):]) == ["b", "b", "b"]
    n = b.pairs.count()
    assert sorted(tuple(r) for r in out.groupBy("config", F.col("fold").isNull().alias("all")).count().collect()) == [(c, a, n) for c in "abc" for a in (False, True)]
    jobs = C.manifest(b.spark, str(tmp_path)).collect()
    assert sorted((j.config, -1 if j.fold is None else j.fold) for j in jobs) == [(c, f) for c in "abc" for f in (-1, 0, 1)]
    assert sum(j.n_rows for j in jobs if j.fold is not None) == 3 * n


def test_binarise_by_map_and_by_join(spark, monkeypatch):
    from rhetree.operators import features

    rows = [(1, {"D#a": "x", "C#n": "3"}), (2, {"D#a": "y", "D#b": "True"}), (3, {"D#b": "False"}), (4, {}), (5, None), (1, {"D#a": "x", "C#n": "3"})]
    frame = spark.createDataFrame(rows, "i int, feats map<string,string>")
    want = sorted([(1, {"D#a=x": "True", "D#a=y": "False", "C#n": "3"})] * 2 + [(2, {"D#a=x": "False", "D#a=y": "True", "D#b": "True"}), (3, {"D#b": "False"}), (4, {}), (5, None)], key=repr)
    key = lambda rs: sorted(((i, None if f is None else dict(sorted(f.items()))) for i, f in rs), key=repr)
    for most in (10_000, 1):
        monkeypatch.setattr(features, "MOST_VALUES", most)
        assert key(features.binarise(frame).collect()) == key(want)


def test_embedded_units_keep_their_tokens(spark):
    units = spark.createDataFrame([("g", "a", 0, 100), ("g", "b", 10, 20)], "grouping string, id string, span_start int, span_end int")
    spans = spark.createDataFrame([("g", 12, 15), ("g", 30, 35)], "grouping string, start int, end int")
    got = {(r.unit_id, r.start) for r in X.within_units(units, spans, embedded=False).collect()}
    assert got == {("b", 12), ("a", 30)}
    assert X.within_units(units, spans).count() == 3


def test_kappa(spark):
    rows = spark.createDataFrame([("a", "a")] * 4 + [("b", "b")] * 4 + [("a", "b"), ("b", "a")], "first string, second string")
    assert X.kappa(rows).first().kappa == pytest.approx(0.6)


def test_leftmost_longest_of_a_null_key(spark):
    rows = [(None, 0, 4), (None, 2, 5), (None, 4, 6), ("d", 1, 3), ("d", 3, 4), ("d", 3, 9), ("d", 5, 10)]
    got = X.leftmost_longest(spark.createDataFrame(rows, "doc string, start int, end int"), ["doc"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, 4), (None, 4, 6), ("d", 1, 3), ("d", 3, 9)], key=str)


def test_offsets_of_a_long_text(spark):
    import time

    forms = [f"W{i}" for i in range(40_000)]
    rows = spark.createDataFrame([(" ".join(forms).lower(), forms)], "text string, forms array<string>")
    start = time.time()
    spans = X.token_offsets(rows).first().spans
    assert spans[-1].end == len(" ".join(forms)) and len(spans) == 40_000
    assert time.time() - start < 20


def test_neighbours_meet_within_documents(spark):
    """Of a word's neighbours only those that its own document has are kept, each once; both forms as by brute force."""
    from rhetree.operators import text as X

    docs = {g: {f"{g}{u}": {f"w{(7 * u + i * (3 + k)) % 60}" for i in range(6)} for u in range(4)} for k, g in enumerate("abc")}
    score = {(f"w{a}", f"w{b}"): 1.0 / (1 + abs(a - b)) for a in range(60) for b in range(60) if (a + b) % 3}
    lemmas = spark.createDataFrame([(g, u, w) for g, us in docs.items() for u, ws in us.items() for w in ws], "grouping string, unit_id string, lemma string")
    neighbours = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "word string, neighbour string, score double")
    known = {g: set().union(*us.values()) for g, us in docs.items()}
    want = sorted((g, a, b, s) for g, ws in known.items() for (a, b), s in score.items() if a in ws and b in ws)
    assert sorted((r.grouping, r.word, r.neighbour, r.score) for r in X._near(lemmas, neighbours).collect()) == want
    pairs = spark.createDataFrame([(g, p, c) for g, us in docs.items() for p in us for c in us if p != c], "grouping string, parent string, child string")

    def side(one, two, matched):
        best = [max((score[a, b] for b in two if (a, b) in score), default=None) for a in one]
        found = [x for x in best if x is not None]
        return sum(found) / max(1, len(found) if matched else len(best))

    for matched in (False, True):
        for r in X.set_similarity(pairs, lemmas, neighbours, matched).collect():
            p, c = docs[r.grouping][r.parent], docs[r.grouping][r.child]
            assert r.similarity == pytest.approx((side(p, c, matched) + side(c, p, matched)) / 2)
